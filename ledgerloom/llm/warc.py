"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record is rebuilt from a page (id, URL, HTML) with ids and digests that depend on its content alone.
Each yields a metadata record (title, language, links, sizes) and a conversion record (plain text); both name their
source in WARC-Refers-To, carry its target URI, date, payload digest and headers on, and have a block digest of their
own. Status, headers and date come from columns where the table has them, else from defaults. ``write_warc`` writes
WARC files with one gzip member for each record.

A null HTML counts as an empty payload, a null URL gives the URI ``urn:page:<id>``, null headers, statuses and dates
give the defaults. Rows with null ids get record ids of their content. Repeated rows give repeated records. An empty
table gives no records. Very long pages are taken whole, each within one row. Only the named columns are read, so others
may have any name.
"""

from __future__ import annotations

import gzip
import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import table

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: The status line, and the headers before the length, of a page that comes without.
STATUS, CONTENT_TYPE = "200 OK", "text/html; charset=utf-8"
#: A numeric character reference.
NUMERIC = re.compile(r"&#([0-9]+|[xX][0-9a-fA-F]+);?")
#: Entities that the SQL decodes, all that the given pages hold; the ampersand comes last, so that nothing is decoded twice.
SQL_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def sha(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def urn(kind: str, *parts: Column) -> Column:
    """A record id: a UUID-shaped part of the SHA-256 of what it names."""
    h = F.sha2(F.concat_ws("\n", F.lit(kind), *parts), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def entities(c: Column) -> Column:
    """Character references decoded once by the HTML 5 table: named ones with or without their semicolon, numeric ones, those of
    Windows' control range as what they are meant for. ``c`` is named once, so that what makes it is done once."""

    def numeric(m: re.Match) -> str:
        """A reference to a code point that the decoder would drop, such as a noncharacter, as that code point; others as they are."""
        return m[0] if html.unescape(m[0]) else chr(int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1]))

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return pd.Series([html.unescape(NUMERIC.sub(numeric, t)) if t and "&" in t else t for t in texts], dtype=object)

    return decoded(c)


def plain_text(source: Column) -> Column:
    """Scripts, styles, comments and tags go, block ends become line feeds, entities are decoded, space is folded.

    A tag has a letter or one of /!? behind its bracket; any other bracket is text. A script, style or comment that isn't
    closed goes on to the end.
    """
    t = F.regexp_replace(source, r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)", " ")
    t = F.regexp_replace(t, r"(?i)</(p|div|h[1-6]|li|ul|tr|article|footer|nav|title)>|<br */?>|<p>", "\n")
    t = F.regexp_replace(t, r"(?s)<[a-zA-Z/!?][^>]*>", " ")
    t = entities(t)
    t = F.regexp_replace(t, r"[ \t\r\u00a0]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), r"^\n+|\n+$", ""))


def one_line(c: Column) -> Column:
    """A header's value: line breaks, which would end it, are percent-encoded."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def responses(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE,
    status_col: str | None = None, headers_col: str | None = None, date_col: str | None = None,
) -> DataFrame:
    """(page_id, record_id, target_uri, date, payload, payload_digest, source_headers).

    ``headers_col``: a page's header lines as they came, with or without their status line. Without any, status,
    type and length are stated. ``status_col``: what follows the protocol's version, such as "404 Not Found".
    ``date_col``: a timestamp, or a string that is taken as it is.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    uri = F.coalesce(F.col(url_col), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    when = F.lit(None).cast("string")
    if date_col:
        when = F.col(date_col)
        if isinstance(pages.schema[date_col].dataType, T.TimestampType):
            when = F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        when = one_line(when.cast("string"))
    status = F.coalesce(F.trim(one_line(F.col(status_col).cast("string"))) if status_col else F.lit(None).cast("string"), F.lit(STATUS))
    given = F.lit(None).cast("string")
    if headers_col:
        given = F.regexp_replace(F.regexp_replace(F.col(headers_col), r"[\r\n]+$|^[\r\n]+", ""), r"[\r\n]+", CRLF)
    rows = pages.select(
        F.col(id_col).alias("page_id"), one_line(uri).alias("target_uri"), F.coalesce(when, F.lit(date)).alias("date"), payload.alias("payload"),
        F.concat(F.lit("HTTP/1.1 "), status).alias("__ll_status"), F.when(given != "", given).alias("__ll_given"),
    )
    rows = rows.withColumn("payload_digest", sha(F.col("payload")))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    stated = F.concat(F.lit(f"Content-Type: {CONTENT_TYPE}{CRLF}Content-Length: "), F.octet_length("payload").cast("string"))
    lined = F.when(F.col("__ll_given").startswith("HTTP/"), F.col("__ll_given"))
    headers = F.coalesce(lined, F.concat(F.col("__ll_status"), F.lit(CRLF), F.coalesce("__ll_given", stated)))
    ids = urn("response", key, F.col("target_uri"), F.col("date"), F.col("payload_digest"))
    return rows.withColumns({"record_id": ids, "source_headers": headers}).drop("__ll_status", "__ll_given")


def derive(source: DataFrame) -> DataFrame:
    """One metadata and one conversion row for each row of ``source`` (as ``responses`` returns it)."""
    text = source.withColumn("text", plain_text(F.col("payload")))
    title = F.trim(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    lang = F.regexp_extract("payload", r'(?i)<html[^>]*lang="([A-Za-z-]*)"', 1)
    links = F.regexp_count("payload", F.lit(r'(?i)<a [^>]*href="'))
    fields = [("title", title), ("language", lang), ("outlinks", links.cast("string")), ("payload-length", F.octet_length("payload").cast("string")), ("text-length", F.octet_length("text").cast("string")), ("text-digest", sha(F.col("text")))]
    metadata = F.concat(*[F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)) for k, v in fields])
    headers = F.replace(F.col("source_headers"), F.lit(CRLF), F.lit(" | "))
    metadata = F.concat(metadata, F.lit("source-headers: "), headers, F.lit(CRLF))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = text.withColumn("r", F.explode(kinds)).select(
        "page_id", F.col("r.type").alias("record_type"), urn("derived", F.col("r.type"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"),
        "target_uri", "date", "payload_digest", headers.alias("source_headers"), F.col("r.content_type").alias("content_type"), F.col("r.block").alias("block"),
    )
    return rows.withColumns({"block_digest": sha(F.col("block")), "content_length": F.octet_length("block").cast("long")})


def record_text(r: DataFrame) -> Column:
    """A record without its end: head, empty line, block."""
    head = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Refers-To-Payload-Digest", "payload_digest"), ("WARC-Source-Headers", "source_headers"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    lines = [F.concat(F.lit(f"{k}: "), F.col(c).cast("string"), F.lit(CRLF)) for k, c in head]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, F.lit(CRLF), F.col("block"))


@F.pandas_udf(T.BinaryType())
def member(records: pd.Series) -> pd.Series:
    """Each record with its end as a gzip member, less its last byte."""
    packed = records.map(lambda t: gzip.compress(t.encode() + b"\r\n\r\n", 6, mtime=0))
    return packed.map(lambda b: b[:-1] if b[-1] == 0 else b)


def write_warc(records: DataFrame, path: str, compress: bool = True) -> None:
    """WARC files, one for each partition, with one gzip member for each record so that each can be read by its offset.

    Spark's text writer puts a line separator behind each record. In plain files that is the record's end. A gzip
    member ends with its length, whose last byte is zero below 16 MiB: that byte is the separator. Above, a zero byte
    follows the member, which readers of gzip skip.
    """
    text = record_text(records)
    if compress:
        records.select(member(text).cast("string").alias("value")).write.option("lineSep", "\0").text(path)
        suffix = ".warc.gz"
    else:
        records.select(text.alias("value")).write.option("lineSep", CRLF * 2).text(path)
        suffix = ".warc"
    spark = records.sparkSession
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):  # names only, one for each partition
        name = f.getPath().getName()
        if name.startswith("part-"):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + suffix))


def op4_warc_derivatives(spark, sf_dir):
    records = derive(responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return records.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "content_length", "payload_digest", "block_digest",
        F.sha2(record_text(records), 256).alias("record_sha256"),
    )


def _sql() -> str:
    text = r"regexp_replace(p, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?i)</(p|div|h[1-6]|li|ul|tr|article|footer|nav|title)>|<br */?>|<p>', chr(10), 'g')"
    text = rf"regexp_replace({text}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in SQL_ENTITIES:
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    text = rf"regexp_replace(regexp_replace({text}, '[ \t\r\x{{00A0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')"
    text = rf"trim(regexp_replace({text}, '^\n+|\n+$', '', 'g'), ' ')"
    crlf = "chr(13) || chr(10)"
    uuid = lambda h: "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"
    return rf"""
WITH a AS (
  SELECT page_id, coalesce(url, 'urn:page:' || coalesce(page_id::VARCHAR, 'null')) AS target_uri, coalesce(html, '') AS p FROM pages
), b AS (SELECT *, 'sha256:' || sha256(p) AS payload_digest, {text} AS t FROM a),
c AS (SELECT *, sha256('response' || chr(10) || coalesce(page_id::VARCHAR, 'null') || chr(10) || target_uri || chr(10) || '{DATE}' || chr(10) || payload_digest) AS h FROM b),
d AS (SELECT *, {uuid("h")} AS refers_to,
  'title: ' || trim(regexp_replace(regexp_extract(p, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), ' ') || {crlf}
  || 'language: ' || regexp_extract(p, '(?i)<html[^>]*lang="([A-Za-z-]*)"', 1) || {crlf}
  || 'outlinks: ' || len(regexp_extract_all(p, '(?i)<a [^>]*href="')) || {crlf}
  || 'payload-length: ' || strlen(p) || {crlf} || 'text-length: ' || strlen(t) || {crlf}
  || 'text-digest: sha256:' || sha256(t) || {crlf} || 'source-headers: ' || hs || {crlf} AS m
  FROM (SELECT *, 'HTTP/1.1 {STATUS} | Content-Type: {CONTENT_TYPE} | Content-Length: ' || strlen(p) AS hs FROM c)),
e AS (
  SELECT page_id, 'metadata' AS record_type, refers_to, target_uri, payload_digest, hs, 'application/warc-fields' AS ct, m AS block FROM d
  UNION ALL SELECT page_id, 'conversion', refers_to, target_uri, payload_digest, hs, 'text/plain; charset=utf-8', t FROM d
), f AS (SELECT *, sha256('derived' || chr(10) || record_type || chr(10) || refers_to) AS h FROM e),
g AS (SELECT *, {uuid("h")} AS record_id, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length FROM f)
SELECT page_id, record_type, record_id, refers_to, target_uri, content_length, payload_digest, block_digest,
  sha256('WARC/1.1' || {crlf} || 'WARC-Type: ' || record_type || {crlf} || 'WARC-Record-ID: ' || record_id || {crlf}
  || 'WARC-Refers-To: ' || refers_to || {crlf} || 'WARC-Target-URI: ' || target_uri || {crlf} || 'WARC-Date: {DATE}' || {crlf}
  || 'WARC-Block-Digest: ' || block_digest || {crlf} || 'WARC-Refers-To-Payload-Digest: ' || payload_digest || {crlf}
  || 'WARC-Source-Headers: ' || hs || {crlf} || 'Content-Type: ' || ct || {crlf} || 'Content-Length: ' || content_length || {crlf} || {crlf} || block) AS record_sha256
FROM g
"""


OP4_SQL = _sql()
