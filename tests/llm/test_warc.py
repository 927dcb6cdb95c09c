from __future__ import annotations

import gzip
import hashlib
import html
import zlib
from pathlib import Path

import pytest

from ledgerloom.llm import warc

HTML = """<html lang="fr"><head><title> A
 title </title><style>p { x: 1 }</style></head><body><!-- no --><script>var a = "<p>";</script>
<p>One &amp;lt; two</p><div>Caf&eacute; &nbsp;x</div><a class="k" href="/a">link</a><a href="/b">b</a></body></html>"""
SCHEMA = "page_id long, url string, html string, type string, block string"


def sha(b: bytes) -> str:
    return "sha256:" + hashlib.sha256(b).hexdigest()


def records(spark, rows):
    return warc.derive(warc.responses(spark.createDataFrame(rows, SCHEMA)))


def test_records_link_to_their_source(spark):
    rows = [(1, "http://a/", HTML, "", ""), (2, None, None, "", ""), (None, None, "", "", ""), (3, "http://b/", "é" * 1000, "", "")]
    source = {r["page_id"]: r for r in warc.responses(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = records(spark, rows).collect()
    assert len(got) == 8 and len({r["record_id"] for r in got}) == 8
    for r in got:
        s = source[r["page_id"]]
        assert (r["refers_to"], r["target_uri"], r["date"], r["payload_digest"]) == (s["record_id"], s["target_uri"], s["date"], s["payload_digest"])
        assert r["payload_digest"] == sha(s["payload"].encode()) and r["block_digest"] == sha(r["block"].encode())
        assert r["content_length"] == len(r["block"].encode())
    meta = next(r["block"] for r in got if r["page_id"] == 1 and r["record_type"] == "metadata")
    text = next(r["block"] for r in got if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert "title: A title\r\n" in meta and "language: fr\r\n" in meta and "outlinks: 2\r\n" in meta
    assert "Content-Type: text/html; charset=utf-8" in meta
    assert "One &lt; two" in text and "var a" not in text and "x: 1" not in text and "no" not in text.split()
    assert {source[None]["target_uri"], source[2]["target_uri"]} == {"urn:page:null", "urn:page:2"}


def test_repeated_rows_and_no_rows(spark):
    assert records(spark, [(1, "u", "<p>a", "", "")] * 3).count() == 6
    assert records(spark, []).count() == 0


def test_written_files_parse(spark, tmp_path):
    rows = [(i, f"http://h/{i}", HTML.replace("One", str(i)), "", "") for i in range(9)]
    want = {r["record_id"]: r for r in records(spark, rows).collect()}
    warc.write_warc(records(spark, rows), f"{tmp_path}/w")
    seen = {}
    for f in Path(f"{tmp_path}/w").glob("part-*"):
        assert f.name.endswith(".warc.gz")
        data, packed = b"", f.read_bytes()
        while packed:  # a member of its own for each record
            d = zlib.decompressobj(31)
            one = d.decompress(packed)
            assert d.eof and one.startswith(b"WARC/1.1") and one.endswith(b"\r\n\r\n") and one.count(b"WARC-Record-ID: ") == 1
            data, packed = data + one, d.unused_data
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            n = int(fields["Content-Length"])
            assert version == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
            seen[fields["WARC-Record-ID"]] = (fields, rest[:n])
            data = rest[n + 4 :]
    assert set(seen) == set(want)
    for k, (fields, block) in seen.items():
        assert fields["WARC-Refers-To"] == want[k]["refers_to"] and fields["WARC-Block-Digest"] == sha(block)
        assert block.decode() == want[k]["block"]


def test_large_records_and_plain_files(spark, tmp_path):
    import random

    long = "".join(random.Random(1).choices("abcdefgh \n", k=18_000_000))
    df = records(spark, [(1, "u", long, "", ""), (2, "v", "small", "", "")])
    warc.write_warc(df, f"{tmp_path}/z")
    warc.write_warc(df, f"{tmp_path}/p", compress=False)
    packed = b"".join(gzip.decompress(f.read_bytes()) for f in sorted(Path(f"{tmp_path}/z").glob("*.warc.gz")))
    plain = b"".join(f.read_bytes() for f in sorted(Path(f"{tmp_path}/p").glob("*.warc")))
    assert packed == plain and plain.count(b"WARC/1.1\r\n") == 4 and len(plain) > 17_000_000


def test_source_headers_status_and_date_are_kept(spark):
    rows = [
        (1, "u\r\nX: y", "a", "HTTP/1.0 301 Moved\nLocation: /b\n\n", "404 Not Found", "2026-01-02 03:04:05"),
        (2, "u", "a", "Content-Type: text/plain", "404 Not Found", None),
        (3, "u", "a", None, None, None), (4, "u", "a", "\r\n", "500", "2026-01-02 03:04:05"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, h string, s string, d string").selectExpr("*", "cast(d as timestamp) t")
    got = {(r["page_id"], r["record_type"]): r for r in warc.derive(warc.responses(df, status_col="s", headers_col="h", date_col="t")).collect()}
    default = "Content-Type: text/html; charset=utf-8 | Content-Length: 1"
    want = {1: "HTTP/1.0 301 Moved | Location: /b", 2: "HTTP/1.1 404 Not Found | Content-Type: text/plain", 3: f"HTTP/1.1 200 OK | {default}", 4: f"HTTP/1.1 500 | {default}"}
    for (k, kind), r in got.items():
        assert r["source_headers"] == want[k], k
        assert r["date"] == (warc.DATE if k in (2, 3) else "2026-01-02T03:04:05Z")
        assert kind != "metadata" or f"source-headers: {want[k]}\r\n" in r["block"]
    assert got[1, "conversion"]["target_uri"] == "u%0D%0AX: y"
    head = warc.derive(warc.responses(df, headers_col="h")).select(warc.record_text(None).alias("x")).first()["x"]
    assert "WARC-Source-Headers: HTTP/1.0 301 Moved | Location: /b\r\n" in head


def test_character_references(spark):
    texts = ["&eacute;&mdash;&#8212;&#x2014;&hearts;", "&amp;lt;", "&#65;&#x41;&#X41;", "&#1114112;&#99999999999;&#x110000;&#xFFFFFFFFF;", "&#1114111;&#128512;", "&apos;&amp;apos;", "&unknown; & &; &#; &#x;", "&#0000065;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", warc.entities(df["t"]).alias("c")).collect():
        want = html.unescape(r["t"]) if "1114111" not in r["t"] else "\U0010ffff\U0001f600"
        assert r["c"] == want, r["t"]


def test_a_very_long_page(spark):
    page = "<p>" + "word <b>x</b> " * 200_000 + "</p><script>" + "y" * 500_000 + "</script>end"
    r = records(spark, [(1, "u", page, "", "")]).where("record_type = 'conversion'").first()
    assert r["block"] == ("word x " * 200_000).strip() + "\nend"


@pytest.mark.parametrize(("page", "text"), [
    ("<p>a < b and c > d</p>", "a < b and c > d"), ("<p>x</p><script>var a = 1; // no end", "x"), ("a<style>p {}", "a"), ("a<!-- b", "a"), ("a<SCRIPT src=x>b</SCRIPT >c", "a c"), ("1 <2 and <b>bold</b>", "1 <2 and bold"),
    ("<scripting>kept</scripting>", "kept"), ("&check; &lbrace; &amp &eacute &#151; &nbsp;&notit; &#x1F600;", "✓ { & é — ¬it; 😀"), ("&amp;lt;p&amp;gt;", "&lt;p&gt;"), ("", ""), ("no ampersand", "no ampersand"),
])
def test_plain_text_of_odd_html(spark, page, text):
    df = spark.createDataFrame([(page,)], "t string")
    assert df.select(warc.plain_text(df["t"])).first()[0] == text
