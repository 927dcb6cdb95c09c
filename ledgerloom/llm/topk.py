"""Exact top-k inner-product search through a pivot-distance index.

Vectors are keyed by their nearest pivot and by the ring their distance to it falls in: an annulus. The directory
holds, for each annulus, its least and greatest distance and its greatest norm. With d a query's distance to the
pivot, no vector of the annulus is nearer to the query than the gap between d and the annulus (triangle
inequality), so its score is at most (|q|^2 + greatest |x|^2 - gap^2) / 2. Each query opens its annuli in order of
that bound: first as many as surely hold k vectors, then those whose bound reaches the k-th score so far; at the
first annulus below it the search stops. Scores are integers and the result is exact; the pivots only decide speed.

Neighbouring annuli lie together in blocks, an annulus larger than a block in several. A query goes once to each block
that has an annulus it opens, with a mask of these, and takes home only what reaches its k-th score so far. Where the
bounds prune nothing, as among random directions, the search is a product of all queries with all vectors in blocks.

Equal vectors are indexed once, with the k + 1 smallest ids of their rows: no result can need another of them.

Vectors that are null, or hold null or non-finite components, and rows with null ids take no part. Vectors of
different lengths are compared as if the shorter ended in zeros. Of rows with equal ids the smallest vector counts.
Scores must fit a long. Empty tables give no rows. Texts play no part; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, shuffle_partitions, table

#: Pivots at least and at most (in between the square root of the vectors over 4), rings for each, and the sample they are
#: fitted on: the directory has at most MOST_PIVOTS * RINGS rows.
PIVOTS, MOST_PIVOTS, RINGS, SAMPLE = 48, 512, 16, 4096
#: Vectors in one block, queries in one block.
BLOCK, QUERIES = 4096, 1024


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): finite vectors as floor(scale * x), one row for each id."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    good = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(finite)
    return good.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where they hold every partial sum, else in Python's integers."""
    if not len(a) or not len(b) or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    return (a.astype(object).dot(b.T.astype(object))).astype(np.int64)


def fit_pivots(vectors: DataFrame, dim: int, pivots: int, sample: int) -> tuple[np.ndarray, float]:
    """Pivots by a few rounds of k-means over the ``sample`` rows with the smallest id hashes, and a ring's width."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    x = matrix(rows["v"], dim)
    if not len(x):
        return x, 1.0
    p = np.unique(x, axis=0)[:: max(1, len(np.unique(x, axis=0)) // pivots)][:pivots]
    for _ in range(5):
        near = distances(x, p).argmin(1)
        p = np.stack([x[near == k].mean(0) if (near == k).any() else p[k] for k in range(len(p))])
    far = distances(x, p).min(1)
    return p, float(max(far.max() / RINGS, 1e-9))


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1) - 2 * x @ p.T, 0))


def layout(sizes: np.ndarray, block: int) -> np.ndarray:
    """(first block, blocks, slot) of each annulus: in turn into blocks of about ``block`` vectors and 256 annuli at most, a larger one alone into several."""
    out, at, filled, slot = [], 0, 0, 0
    for n in sizes.tolist():
        if slot and (filled + n > block or slot == 256):
            at, filled, slot = at + 1, 0, 0
        parts = max(1, -(-n // block))
        out.append((at, parts, slot))
        if parts > 1:
            at, filled, slot = at + parts, 0, 0
        else:
            filled, slot = filled + n, slot + 1
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def masks(places: np.ndarray) -> list[dict]:
    """Blocks of the annuli at ``places`` (from ``layout``, in order), each with the bits of their slots."""
    out = []
    starts = np.flatnonzero(np.diff(places[:, 0], prepend=-1))
    for part in np.split(places, starts[1:]) if len(places) else []:
        bits = np.zeros(256, bool)
        bits[part[:, 2]] = True
        mask = np.packbits(bits).tobytes()
        out += [{"block": int(part[0, 0] + i), "opens": mask} for i in range(part[0, 1])]
    return out


def bounds(q: np.ndarray, pivots: np.ndarray, d: pd.DataFrame) -> np.ndarray:
    """Upper bound of each query's score in each annulus, a little above for rounding."""
    at = distances(q, pivots)[:, d["pivot"].to_numpy()]
    gap = np.maximum(np.maximum(at - d["far"].to_numpy(), d["near"].to_numpy() - at), 0)
    gap = np.maximum(gap - 1e-6 * (at + 1), 0)
    q2 = (q**2).sum(1)[:, None]
    by_gap = (q2 + d["norm2"].to_numpy() - gap**2) / 2
    by_length = np.sqrt(q2 * d["norm2"].to_numpy())
    return np.minimum(by_gap, by_length) * (1 + 1e-9) + 1.0


def scored(opened: DataFrame, blocks: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each block a query is sent to, its k best in the annuli it opens that reach ``reach``.

    ``opened``: query_id, q, reach, block, opens (a byte of bits for eight annuli of the block). Queries of a block go in
    parts, too; a pair of block and part is one unit of work.
    """
    asking = opened.groupBy("block").agg(F.count("*").alias("asking"))
    part = F.pmod(F.xxhash64("query_id"), F.greatest(F.ceil(F.col("asking") / QUERIES), F.lit(1)))
    asked = opened.join(asking, "block").withColumn("part", part).groupBy("block", "part").agg(F.collect_list(F.struct("query_id", "q", "reach", "opens")).alias("asked"))
    pairs = asked.repartition(4 * shuffle_partitions(opened.sparkSession), "block", "part").join(blocks, "block")

    def run(asked_, held) -> pd.DataFrame:
        qid = np.array([a["query_id"] for a in asked_], np.int64)
        reach = np.array([a["reach"] for a in asked_], np.float64)
        opens = np.unpackbits(np.frombuffer(b"".join(a["opens"] for a in asked_), np.uint8).reshape(len(qid), -1), axis=1).astype(bool)
        held = sorted(held, key=lambda h: h["ids"][0])  # ties at the edge go to smaller ids
        q, x = matrix([a["q"] for a in asked_], dim), matrix([h["v"] for h in held], dim)
        slot = np.array([h["slot"] for h in held])
        s = product(q, x)
        whole = opens[:, slot] & (s >= reach[:, None])
        if len(held) > k + 1:  # k + 1 vectors, ties at the edge all in: one of them may be the query's own
            shown = np.where(whole, s, np.iinfo(np.int64).min)
            whole &= shown >= np.partition(shown, len(held) - k - 1, axis=1)[:, [len(held) - k - 1]]
        row, at = np.nonzero(whole)
        order = np.lexsort((at, -s[row, at], row))
        row, at = row[order], at[order]
        first = np.searchsorted(row, row, side="left")
        few = np.arange(len(row)) - first <= k
        row, at = row[few], at[few]
        ids = [held[j]["ids"] for j in at]
        times = np.array([len(i) for i in ids], np.int64)
        out = pd.DataFrame({"query_id": np.repeat(qid[row], times), "vec_id": np.array([i for one in ids for i in one], np.int64), "score": np.repeat(s[row, at], times)})
        return out[out["query_id"] != out["vec_id"]]

    def units(batches):
        for pdf in batches:
            for asked_, held in zip(pdf["asked"], pdf["held"], strict=True):
                yield run(asked_, held)

    return pairs.select("asked", "held").mapInPandas(units, "query_id long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``rows`` for which ``is_query`` (over vec_id) holds, against all."""
    spark = rows.sparkSession
    vectors = cut(integer_vectors(rows, id_col, vec_col))
    total = vectors.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    dim = total["dim"] or 1  # no vector, or empty ones only: all scores are 0
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, int(total["n"] ** 0.5) // 4))
    p, width = fit_pivots(vectors, dim, pivots, sample)
    if not len(p):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = W.partitionBy("v").orderBy("vec_id")
    distinct = vectors.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    distinct = distinct.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    @F.pandas_udf("annulus int, distance double, norm2 double")
    def key(v: pd.Series) -> pd.DataFrame:
        x = matrix(v, dim)
        d = distances(x, p)
        near = d.argmin(1)
        far = d[np.arange(len(x)), near]
        ring = np.minimum(far / width, RINGS - 1).astype(int)
        return pd.DataFrame({"annulus": near * RINGS + ring, "distance": far, "norm2": (x**2).sum(1)})

    keyed = cut(distinct.withColumn("key", key("v")).select("v", "ids", "key.annulus", "key.distance", "key.norm2"))
    stats = keyed.groupBy("annulus").agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("norm2").alias("norm2"), F.sum(F.size("ids")).alias("n"), F.count("*").alias("v"))
    directory = stats.orderBy("annulus").toPandas()  # at most MOST_PIVOTS * RINGS rows
    directory["pivot"] = directory["annulus"] // RINGS
    sizes, places = directory["n"].to_numpy(np.int64), layout(directory["v"].to_numpy(np.int64), block)
    at = spark.createDataFrame([(int(a), *map(int, place)) for a, place in zip(directory["annulus"], places, strict=True)], "annulus int, block long, parts long, slot int")
    blocks = keyed.join(F.broadcast(at), "annulus").withColumn("block", F.col("block") + F.pmod(F.xxhash64("v"), F.col("parts")))
    blocks = cut(blocks.groupBy("block").agg(F.collect_list(F.struct("slot", "v", "ids")).alias("held")))
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def opens(q: pd.Series, reach: np.ndarray | None) -> list[list[dict]]:
        """Blocks with the annuli to open, by falling bound. reach None: those that hold k others for sure; else the rest, up to the first below reach."""
        upper = bounds(matrix(q, dim), p, directory)
        out = []
        for row in range(len(upper)):
            order = np.argsort(-upper[row], kind="stable")
            head = int(np.searchsorted(np.cumsum(sizes[order]), k + 1) + 1)
            chosen = order[:head] if reach is None else order[head:][upper[row][order[head:]] >= reach[row]]
            out.append(masks(places[np.sort(chosen)]))
        return out

    opened = "array<struct<block:bigint,opens:binary>>"

    @F.pandas_udf(opened)
    def opens_first(q: pd.Series) -> pd.Series:
        return pd.Series(opens(q, None))

    @F.pandas_udf(opened)
    def opens_rest(q: pd.Series, reach: pd.Series) -> pd.Series:
        return pd.Series(opens(q, reach.to_numpy(np.float64)))

    least = F.lit(float("-inf"))
    sent = lambda df, o: df.withColumn("o", F.explode(o)).select("query_id", "q", "reach", "o.block", "o.opens")
    found = cut(best(scored(sent(queries.withColumn("reach", least), opens_first("q")), blocks, dim, k), k).select("query_id", "vec_id", "score"))
    edge = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("reach"))
    known = queries.join(edge, "query_id", "left").withColumn("reach", F.coalesce("reach", least))
    out = best(found.unionByName(scored(sent(known, opens_rest("q", "reach")), blocks, dim, k)), k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_exact_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
