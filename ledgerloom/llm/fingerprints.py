"""Canonical exact digests of documents (native: DataFrame functions only).

The canonical form of a text is its NFKC form, case-folded, with each run of white space as one space and none at
the ends. The fingerprint is two chained 64-bit xxhashes of that form, 32 hex digits; inside each bucket of equal
digests the canonical bytes are compared, and a bucket that holds more than one form gets the forms' SHA-256
appended. Equal canonical forms have equal fingerprints, different ones different fingerprints.

Null texts count as empty. Repeated rows each keep their row. Empty tables give empty results. Very long texts are
read whole, each by one task. Other columns of the documents are ignored, whatever their names. Bytes are compared
among the stored documents; an edited text whose digest is that of a bucket with several forms gets its SHA-256 too.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

#: Rows aimed at in one range bucket, and the most coarse and fine ranges (their product bounds what is broadcast).
BUCKET_ROWS, COARSE, FINE = 4000, 256, 256
FIRST = -(2**63)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding may leave decomposable pairs), white space folded."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def digest(canon: Column) -> Column:
    """128 bits: the second xxhash64 is seeded by the hash of a constant, so the halves are independent."""
    half = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.lower(F.concat(half(F.xxhash64(canon)), half(F.xxhash64(F.lit("second half"), canon))))


def split_buckets(df: DataFrame, digest_col: str, canon_col: str) -> DataFrame:
    """Digests whose bucket holds more than one canonical form, found by comparing the bytes themselves.

    Grouping by digest and form compares the bytes of forms with equal digests, and does so on the map side
    first: a hot bucket sends one row from each task.
    """
    forms = df.groupBy(digest_col, canon_col).agg(F.lit(1).alias("__ll_one"))
    return forms.groupBy(digest_col).agg(F.count("*").alias("__ll_n")).where("__ll_n > 1").select(digest_col)


def with_next(docs: DataFrame, key: str, tie: str, carry: list[str]) -> DataFrame:
    """``docs`` (key, tie: non-null longs) with ``next_<c>`` of the row that follows in the order of (key, tie), cyclically.

    Rows are dealt into ranges of the key and looked at range by range. A key that many rows share is a range of its
    own, dealt by the tie into as many slices as its rows need; only rows equal in both stay together. The first rows
    of each range are also sent to the range before, so that no range needs another; at most 4 * COARSE * FINE pairs
    are broadcast for it.
    """
    lowest = F.min(F.when(F.col(key) > FIRST, F.col(key)))
    n, low, above = docs.agg(F.count("*"), F.min(key), lowest).first()
    if not n:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carry])
    coarse = min(COARSE, max(1, n // BUCKET_ROWS))
    fine = min(FINE, max(1, n // (coarse * BUCKET_ROWS)))
    weight = Counter(docs.select(F.percentile_approx(key, [i / coarse for i in range(coarse + 1)], 20 * coarse)).first()[0])
    shared = {c for c, m in weight.items() if m > 1} | {low}
    cuts = {*weight, *shared, *(c + 1 for c in shared if c < 2**63 - 1)} | ({above} if above is not None else set())
    cuts = sorted(cuts)
    ends = [*cuts[1:], cuts[-1] + 1]
    slices = [fine * max(1, weight[c]) for c in cuts]
    base = [0, *accumulate(slices)]

    def find(lo: int, hi: int) -> Column:
        """Index of the last cut that is not above the key."""
        if hi - lo <= 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(cuts[mid]), find(lo, mid)).otherwise(find(mid, hi))

    def of_range(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("__ll_c") + 1)

    start, end = of_range([float(c) for c in cuts]), of_range([float(e) for e in ends])
    by_tie = (F.col(tie).cast("double") + 2.0**63) / 2.0**64
    by_key = (F.col(key).cast("double") - start) / F.greatest(end - start, F.lit(1.0))
    share = F.when(of_range([e - c == 1 for c, e in zip(cuts, ends)]), by_tie).otherwise(by_key)
    size = of_range(slices)
    dealt = docs.withColumn("__ll_c", find(0, len(cuts)))
    dealt = dealt.withColumn("__ll_b", of_range(base[:-1]) + F.least(F.greatest(F.floor(share * size), F.lit(0)), size - 1))
    firsts = dealt.groupBy("__ll_b").agg(F.min(F.struct(key, tie)).alias("f")).orderBy("__ll_b").collect()  # bounded as said above
    prior = [(*firsts[i]["f"], firsts[i - 1]["__ll_b"]) for i in range(len(firsts))]
    spark = docs.sparkSession
    ghosts = spark.createDataFrame(prior, "__ll_first long, __ll_first_tie long, __ll_prior long")
    both = dealt.join(F.broadcast(ghosts), (dealt[key] == ghosts["__ll_first"]) & (dealt[tie] == ghosts["__ll_first_tie"]), "left")
    own = F.struct(F.col("__ll_b").alias("b"), F.lit(0).alias("g"))
    ghost = F.struct(F.col("__ll_prior").alias("b"), F.lit(1).alias("g"))
    places = F.when(F.col("__ll_prior").isNull(), F.array(own)).otherwise(F.array(own, ghost))
    both = both.withColumn("__ll_at", F.explode(places))
    w = W.partitionBy("__ll_at.b").orderBy("__ll_at.g", key, tie)
    led = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return led.where("__ll_at.g = 0").drop("__ll_c", "__ll_b", "__ll_first", "__ll_first_tie", "__ll_prior", "__ll_at")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) and the same of the edited text, with the likeness of both and of the next row's.

    The edited text is the text with its last quarter (in code points, rounded down) replaced by as many code
    points from the start of the next document by id, or all of it if it is shorter; the last document is followed
    by the first. Rows with null ids come first; rows with equal ids follow each other by the hash of their text.
    The likeness of two exact digests is 1 or 0.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col), F.lit(FIRST)).alias("__ll_key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    base = base.withColumns({"__ll_tie": F.xxhash64("text"), "__ll_ct": canonical(F.col("text"))})
    base = base.withColumns({"d": F.unhex(digest(F.col("__ll_ct"))), "st": F.unhex(F.sha2("__ll_ct", 256))}).drop("__ll_ct")
    led = with_next(base, "__ll_key", "__ll_tie", ["text", "d"])
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - k), F.substr("next_text", F.lit(1), k))
    led = led.select("doc_id", "d", "st", "text", "next_text", F.col("next_d").alias("dn"), n.cast("long").alias("n_chars"), edited.alias("__ll_e"))
    led = led.withColumn("__ll_ce", canonical(F.col("__ll_e")))
    led = led.withColumns({"de": F.unhex(digest(F.col("__ll_ce"))), "se": F.unhex(F.sha2("__ll_ce", 256))})
    own = canonical(F.col("text"))  # needed again only where digests are equal
    same = lambda x, form: F.when(F.col("d") != F.col(x), 0.0).otherwise((own == form).cast("double"))
    narrow = led.select(
        "doc_id", "n_chars", F.unhex(F.sha2("__ll_e", 256)).alias("edited_sha256"), "d", "de", "st", "se",
        same("de", F.col("__ll_ce")).alias("near_edited"), same("dn", canonical(F.col("next_text"))).alias("near_next"),
    )
    forms = docs.select(canonical(F.col(text_col)).alias("__ll_c")).select(digest(F.col("__ll_c")).alias("d"), "__ll_c")
    split = split_buckets(forms, "d", "__ll_c").select(F.unhex("d").alias("d"))
    out = narrow.join(split.select(F.col("d"), F.lit(True).alias("x")), "d", "left")
    out = out.join(split.select(F.col("d").alias("de"), F.lit(True).alias("xe")), "de", "left")
    text = lambda c: F.lower(F.hex(c))
    whole = lambda d, x, s: F.when(F.col(x), F.concat(text(d), F.lit("-"), text(s))).otherwise(text(d))
    return out.select(
        "doc_id", "n_chars", text("edited_sha256").alias("edited_sha256"), whole("d", "x", "st").alias("fingerprint"),
        whole("de", "xe", "se").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op8_document_fingerprints(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
