"""Importance resampling towards a target: hashed word runs, gains of the target over the raw texts, Gumbel top draws.

One scan of a text keeps a ring of running CRC states, one for each of the last n starts: a word extends every state
by a space and itself and opens a state of its own in the place of the oldest, so each state is the CRC of a run of
1 to n words. The runs' buckets are counted as they come; a text leaves at most ``buckets`` pairs of bucket and count,
which are written once and read both for the counts of all texts and for each text's weight.

Words are runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased. The gains are ``buckets``
numbers, the only thing that goes to every task. Draws are the greatest scores, ties to smaller ids, numbered across
a range-partitioned sort, so no task ranks more than its share.

Null and empty texts have no words: weight 0 and never drawn unless ``least_words`` is 0. Rows with equal ids are drawn
each for itself and share the random part of the score; a null id counts as the empty string there and comes first in
ties. Texts are read whole as a stream, so a very long one takes no more memory than itself. Empty tables give no rows
(an empty target: every count of it is 0). Only the id and the text are read, whatever other columns are named.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import numbered, stored, table

#: Longest run, buckets, words of a document that can be drawn, percentage that is drawn, and the seed.
RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10000, 20, 10, 2024
#: Runs that are counted at once.
FLUSH = 1 << 16

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ring_scan(text: bytes, n: int, buckets: int) -> tuple[int, int, np.ndarray]:
    """(words, runs, count of each bucket) of one text in UTF-8."""
    counts = np.zeros(buckets, np.int64)
    ring, held, words, runs = [], [], 0, 0
    for found in _WORD.finditer(text.translate(_LOWER)):
        word = found[0]
        if n > 1:
            spaced = b" " + word
            ring = [crc32(spaced, state) for state in ring]
            if len(ring) < n:
                ring.append(crc32(word))
            else:
                ring[words % n] = crc32(word)
            held += ring
        else:
            held.append(crc32(word))
        words += 1
        if len(held) >= FLUSH:
            counts += np.bincount(np.array(held, np.int64) % buckets, minlength=buckets)
            runs += len(held)
            held = []
    if held:
        counts += np.bincount(np.array(held, np.int64) % buckets, minlength=buckets)
    return words, runs + len(held), counts


def features(texts: DataFrame, id_col: str | None, text_col: str = "text", n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, bucket, times): of each text the buckets of its runs and how often each occurs."""

    @F.pandas_udf("n_words long, n_features long, bucket array<int>, times array<long>")
    def scan(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            words, runs, counts = ring_scan(t or b"", n, buckets)
            at = np.flatnonzero(counts)
            rows.append((words, runs, at.astype(np.int32), counts[at]))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "bucket", "times"])

    ident = (F.col(id_col) if id_col else F.lit(None).cast("long")).alias("id")
    return texts.select(ident, scan(F.col(text_col).cast("binary")).alias("f")).select("id", "f.*")


def bucket_counts(told: DataFrame, out: str) -> DataFrame:
    """(bucket, ``out``): how many runs of all texts fall into each bucket."""
    return told.select(F.explode(F.arrays_zip("bucket", "times")).alias("p")).groupBy("p.bucket").agg(F.sum("p.times").alias(out))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: a thousand times the smoothed log ratio of its share in the target and in the raw texts."""
    spark = raw.sparkSession
    all_s, all_t = (x.agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0] for x in (raw, target))
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(bucket_counts(raw, "s"), "bucket", "left").join(bucket_counts(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    one = lambda c: (F.col(c) + 1).cast("double")
    ratio = one("t") * F.lit(float(all_s + buckets)) / (one("s") * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighted(told: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``told`` with weight: the floored mean of its runs' gains, 0 without runs."""
    table_ = np.zeros(buckets, np.int64)
    for r in gain.collect():  # ``buckets`` rows
        table_[r["bucket"]] = r["gain"]

    @F.pandas_udf("long")
    def weigh(bucket: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series([int(table_[b] @ t) if len(b) else 0 for b, t in zip(bucket, times, strict=True)], dtype="int64")

    total = told.withColumn("total", weigh("bucket", "times"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    return total.withColumn("weight", mean.cast("long")).drop("total", "bucket", "times")


def gumbel(id_col: str, seed: int):
    """A thousand times a Gumbel draw, floored, that depends on the seed and the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of every document; rank is null where it isn't drawn."""
    told = stored(features(docs, id_col, text_col, n, buckets))
    aim = stored(features(target, None, target_col, n, buckets))
    rows = weighted(told, gains(told, aim, buckets), buckets).withColumn("score", F.col("weight") + gumbel("id", seed))
    can = rows.where(F.col("n_words") >= least_words)
    drawn, count = numbered(can, [F.desc("score"), F.asc("id"), F.asc("n_features"), F.asc("weight")], "rank")
    quota = percent * count // 100
    ranked = drawn.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    out = ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark, sf_dir):
    docs, aim = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs, aim).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH crc_row AS (
  SELECT i, list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v FROM range(256) AS x(i)
), crc AS (
  SELECT list(v ORDER BY i) AS step FROM crc_row
), texts AS (
  SELECT row_number() OVER () AS r, 'd' AS side, doc_id, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT row_number() OVER (), 'b', NULL, coalesce(text, '') FROM benchmark
), words AS (
  SELECT side, r, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
), spelled AS (
  SELECT w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT w FROM words)
), hashed AS (
  SELECT w, xor(list_reduce(bytes, lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM spelled, crc
), runs AS (
  SELECT side, r, bucket FROM words JOIN hashed USING (w)
), sums AS (
  SELECT count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM runs
), gain AS (
  SELECT bucket, floor(1000 * ln((n_t + 1)::DOUBLE * (s + 10000)::DOUBLE / ((n_s + 1)::DOUBLE * (t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT bucket, count(*) FILTER (side = 'd') AS n_s, count(*) FILTER (side = 'b') AS n_t FROM runs GROUP BY bucket), sums
), weights AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM runs JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT x.r, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM texts x LEFT JOIN weights USING (r) WHERE side = 'd'
), final AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), numbered AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS k, count(*) OVER () AS eligible FROM final WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * eligible // 100 THEN k END::BIGINT AS rank FROM final LEFT JOIN numbered USING (r)
"""
