"""Mixing sources to target weights by the cube method of balanced sampling.

Each source has a target in words. All its documents are taken floor(r) times, r being target over size, and the
rest is an inclusion probability that the cube method turns into zero or one: probabilities move through the null
space of the constraints (the words taken and the documents taken stay as they are) until at most as many are
fractional as there are constraints. Blocks of one source move on their own; what each leaves, at most two
documents, is dealt into fewer blocks, level by level, until one block of a source is left and lands: of all
ways to round what is fractional there and twelve documents kept back, it takes the nearest to the word total.

Null texts have size 0. Rows equal in id, source, size and text are one unit, taken together. Sources are ordered
by code point, null last. An empty table gives no rows; a source without words has target 0. Of a text only the number
of its words is kept, however long it is; columns named like the result's belong to the documents and are read only where
they are named.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, table

#: Units that one task of the flight phase holds for one source.
BLOCK = 2048
#: Documents of all sizes kept for the landing, so that it can come near the word total.
HELD = 12
UNIT = "doc_id long, source string, size long, h long, m long, pi double"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict:
    """Source to target: shares of ``share`` times all sizes by weight, the excess over ``most`` times a source reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size, out = dict(order), {}
    left, open_ = share * sum(size.values()), [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if part[s] > most * size[s]]
        if not full:
            return out | part
        for s in full:
            out[s] = most * size[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in set(full)]
    return out


def flight(pi: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> None:
    """Moves ``pi`` in place while ``rows`` @ pi (one or two constraints) stays, until at most len(rows) are fractional."""
    eps, p = 1e-9, len(rows)
    free = [int(i) for i in np.flatnonzero((pi > eps) & (pi < 1 - eps))]
    value, cols = {i: float(pi[i]) for i in free}, {i: [float(r[i]) for r in rows] for i in free}
    draws, at, waiting, held = rng.random(len(free) + p + 1), 0, free[::-1], []
    while True:
        while len(held) <= p and waiting:
            held.append(waiting.pop())
        if len(held) <= p:
            break
        a = [cols[i] for i in held]
        if p == 2:
            u = [a[1][0] * a[2][1] - a[2][0] * a[1][1], a[2][0] * a[0][1] - a[0][0] * a[2][1], a[0][0] * a[1][1] - a[1][0] * a[0][1]]
            if not any(u):
                u = [a[1][1], -a[0][1], 0.0] if a[0][1] or a[1][1] else [a[1][0], -a[0][0], 0.0]
        else:
            u = [a[1][0], -a[0][0]]
        if not any(u):
            u = [1.0] + [0.0] * p
        up = min((1 - value[i]) / x if x > 0 else -value[i] / x for i, x in zip(held, u, strict=True) if x)
        down = min(value[i] / x if x > 0 else (value[i] - 1) / x for i, x in zip(held, u, strict=True) if x)
        step = up if draws[at % len(draws)] * (up + down) < down else -down
        at += 1
        for i, x in zip(held, u, strict=True):
            v = value[i] + step * x
            value[i] = 0.0 if v < eps else 1.0 if v > 1 - eps else v
        held = [i for i in held if 0.0 < value[i] < 1.0]
    for i, v in value.items():
        pi[i] = v


def land(pi: np.ndarray, words: np.ndarray, m: np.ndarray, want: tuple[float, float]) -> None:
    """The few units still fractional: of all ways to round them, the nearest to the word total, then to the document total."""
    free = np.flatnonzero((pi > 0) & (pi < 1))
    if not len(free):
        return
    ways = (np.arange(1 << len(free))[:, None] >> np.arange(len(free))) & 1
    rest = np.ones(len(pi), bool)
    rest[free] = False
    off_words = np.abs(ways @ words[free] + pi[rest] @ words[rest] - want[0])
    off_docs = np.abs(ways @ m[free] + pi[rest] @ m[rest] - want[1])
    pi[free] = ways[np.lexsort((off_docs, off_words))[0]]


def decide(units: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """``units`` (UNIT) with pi 0 or 1."""
    spark, level, done, open_ = units.sparkSession, 0, [], units

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size"], kind="stable", ignore_index=True)
        key = [seed, int(pdf["level"].iloc[0]), int(pdf["block"].iloc[0]), *((pdf["source"].iloc[0] or "").encode())]
        rng = np.random.default_rng(key)
        pi, m = pdf["pi"].to_numpy(np.float64).copy(), pdf["m"].to_numpy(np.float64)
        words = pdf["size"].to_numpy(np.float64) * m
        want, both = (float(pi @ words), float(pi @ m)), np.vstack([words, m])
        if pdf["blocks"].iloc[0] > 1:
            flight(pi, both, rng)
        else:  # documents spread evenly over the sizes wait for the landing
            by_size = np.argsort(words, kind="stable")
            held = by_size[np.unique(np.linspace(0, len(pi) - 1, HELD).astype(int))]
            rest = np.setdiff1d(np.arange(len(pi)), held)
            moved = pi[rest]
            flight(moved, both[:, rest], rng)
            pi[rest] = moved
            land(pi, words, m, want)
        return pdf.assign(pi=pi).drop(columns=["blocks", "block", "level"])

    while True:
        counts = open_.groupBy("source").count().collect()  # a row for each source
        if not counts:
            break
        blocks = spark.createDataFrame([(r["source"], -(-r["count"] // block)) for r in counts], "s string, blocks long")
        dealt = open_.join(F.broadcast(blocks), open_["source"].eqNullSafe(blocks["s"])).drop("s")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks"))).withColumn("level", F.lit(level))
        moved = cut(dealt.groupBy("source", "block").applyInPandas(run, UNIT))
        done.append(moved.where("pi = 0 or pi = 1"))
        open_, level = moved.where("pi > 0 and pi < 1"), level + 1
    out = done[0] if done else units
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def row_hash(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")), F.col(source_col))


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, h, size, source_size, target, copies, m): one row for each unit of m equal rows."""
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), row_hash(id_col, text_col, source_col).alias("h"))
    units = cut(rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("m")))
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("n")).collect()  # a row for each source
    size = {r["source"]: r["n"] for r in sums}
    target = targets(list(size.items()), weights, share, most)
    plan = [(s, n, float(target[s]), target[s] / n if n else 0.0) for s, n in size.items()]
    plan = spark.createDataFrame(plan, "s string, source_size long, target double, r double")
    known = units.join(F.broadcast(plan), units["source"].eqNullSafe(plan["s"])).drop("s")
    pi = F.col("r") - F.floor("r")
    known = known.withColumn("pi", F.when(pi < 1e-9, 0.0).when(pi > 1 - 1e-9, 1.0).otherwise(pi))
    fixed = known.where("pi = 0 or pi = 1").select("doc_id", "source", "size", "h", "m", "pi")
    drawn = fixed.unionByName(decide(known.where("pi > 0 and pi < 1").select("doc_id", "source", "size", "h", "m", "pi"), seed))
    out = drawn.join(F.broadcast(plan), drawn["source"].eqNullSafe(plan["s"])).drop("s")
    return out.select("doc_id", "source", "h", "size", "source_size", "target", (F.floor("r") + F.col("pi").cast("long")).alias("copies"), "m")


def repeat_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    units = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0")
    units = units.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__ll_id"), F.col("h").alias("__ll_h"), F.col("copies").alias("__ll_copies"))
    keyed = docs.withColumns({"__ll_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "__ll_h": row_hash(id_col, text_col, source_col)})
    taken = keyed.join(units, ["__ll_id", "__ll_h"])
    return taken.withColumn("__ll_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__ll_copies")))).select(*docs.columns)


def op9_mixing_sources(spark, sf_dir):
    units = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    rows = units.withColumn("__ll_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
