"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints are computed from whole texts, one per row, and only distinct ones are indexed. Sorted by Gray rank,
neighbours share long bit patterns. The rank order is cut into groups of about equal size; each group has a mask of
the bits that all its fingerprints share and their pattern. Two groups differ by at least the differing bits where
both masks hold, so pairs of groups beyond the limit are pruned as a whole. For a pair that is left, one task goes
down the two groups' own hierarchies in the same way, level by level, with the bits factored out at each node.

What a task finds leaves it as a spanning forest, not as pairs, so that a group of many near copies gives one row
for each fingerprint; within a tree, each node has at most SPREAD others below it, so that no node is a hot key.
Connected components are then computed by label propagation with shortcuts.

Each fingerprint is sent to as many pairs of groups as its own group is near: with g bits shared by a group of random
fingerprints about 1 + g + g^2 / 2 + g^3 / 6 of 2^g, and all groups while g is small.

Null and empty texts, and texts without words, have fingerprint zero. Texts are read whole, however long, shingles in
blocks. Columns of ``docs`` other than the id and the text are ignored, whatever their names. Texts with fewer words than a shingle have one
shingle of all their words. Rows with null ids get the component of their fingerprint; a component with null ids
only is null. Repeated rows each keep their row.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, salted_rank, shuffle_partitions, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Children of a node, and the most node pairs that a task looks at at once.
FAN, FRONTIER = 8, 1 << 17
#: Rows of a group at most and at least, the most groups (beyond, they have more rows), and edges from one node that a task returns.
GROUP, LEAST, GROUPS, SPREAD = 1 << 18, 1024, 4096, 64


def fingerprint(text: str | None, shingle: int) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def majority(hashed: np.ndarray) -> int:
    """The word with each bit set that over half of the hashes have set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 16):  # a block at a time: very long texts
        block = hashed[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(out, of(F.col(text_col)))


def gray_rank(fp: Column) -> Column:
    """Position of a word in the reflected Gray order, as a long whose signed order is that of the rank."""
    r = fp
    for k in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, k))
    return r.bitwiseXOR(F.lit(-(2**63)))


class Node:
    """The levels of one group: for each level, the mask of shared bits and their pattern for each node."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.levels = fps, []
        ones, some = fps, fps
        self.levels.append((np.full(len(fps), ~np.uint64(0)), fps))
        while len(ones) > 1:
            at = np.arange(0, len(ones), FAN)
            ones, some = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(some, at)
            self.levels.append((~(ones ^ some), ones))


def root_of(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = parent[up]


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]: the greater root hangs below the smaller until no pair is apart."""
    while len(a):
        a, b = root_of(parent, a), root_of(parent, b)
        keep = a != b
        a, b = a[keep], b[keep]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def forest(left: np.ndarray, right: np.ndarray | None, limit: int) -> np.ndarray:
    """Parents (indexes into left, then right) of a forest that spans all links of at most ``limit`` bits.

    right None: links within left. Node pairs are looked at depth first in blocks; a pair is pruned when the bits
    that both nodes share differ in more than ``limit`` places.
    """
    a = Node(left)
    b = a if right is None else Node(right)
    offset = 0 if right is None else len(left)
    parent = np.arange(len(left) + (0 if right is None else len(right)))
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    kids = np.arange(FAN)
    while stack:
        la, lb, i, j = stack.pop()
        if not (la or lb):
            apart = parent[i] != parent[j + offset]
            union(parent, i[apart], j[apart] + offset)
            continue
        if len(i) * FAN * FAN > FRONTIER and len(i) > 1:
            half = len(i) // 2
            stack += [(la, lb, i[half:], j[half:]), (la, lb, i[:half], j[:half])]
            continue
        na, nb = max(la - 1, 0), max(lb - 1, 0)
        ci = i[:, None] * FAN + kids if la else i[:, None]
        cj = j[:, None] * FAN + kids if lb else j[:, None]
        x = np.repeat(ci, cj.shape[1], axis=1).ravel()
        y = np.tile(cj, (1, ci.shape[1])).ravel()
        inside = (x < len(a.levels[na][1])) & (y < len(b.levels[nb][1]))
        if right is None:
            inside &= x <= y if (na or nb) else x < y
        x, y = x[inside], y[inside]
        (ma, pa), (mb, pb) = a.levels[na], b.levels[nb]
        near = np.bitwise_count((pa[x] ^ pb[y]) & ma[x] & mb[y]) <= limit
        stack.append((na, nb, x[near], y[near]))
    return root_of(parent, np.arange(len(parent)))


def links(distinct: DataFrame, limit: int = 3, group_rows: int | None = None) -> DataFrame:
    """(a, b), a < b: edges between fingerprints (column fp) that connect exactly what links within ``limit`` bits do.

    Groups have at most GROUP rows, up to GROUPS of them, and are smaller only as far as every task should have a few
    pairs. The directory, one mask and pattern for each group, is looked up where a group lies; a group is then sent
    once to each pair it is in.
    """
    n = distinct.count()
    if not n:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    spread = 2 * math.isqrt(shuffle_partitions(distinct.sparkSession)) + 1
    wanted = -(-n // group_rows) if group_rows else max(-(-n // GROUP), min(spread, -(-n // LEAST)))
    groups = min(GROUPS, wanted)
    ranked = distinct.select(gray_rank(F.col("fp")).alias("gray"))
    cuts = ranked.select(F.percentile_approx("gray", [i / groups for i in range(groups)], 20 * groups)).first()[0]
    edges = np.array(sorted(set(cuts[1:])), dtype=np.int64)

    @F.pandas_udf("int")
    def look(gray: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, gray.to_numpy(np.int64), side="right").astype(np.int32))

    fp = F.col("gray").bitwiseXOR(F.lit(-(2**63)))
    fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, 1))
    dealt = ranked.select(look("gray").alias("g"), "gray", fp.alias("fp")).groupBy("g")
    packed = cut(dealt.agg(F.array_sort(F.collect_list("gray")).alias("grays"), F.expr("bit_and(fp)").alias("ones"), F.expr("bit_or(fp)").alias("some")))
    directory = packed.select("g", "ones", "some").toPandas()  # at most GROUPS rows
    ids, ones = directory["g"].to_numpy(np.int32), directory["ones"].to_numpy(np.int64)
    mask = ~(ones ^ directory["some"].to_numpy(np.int64))

    @F.pandas_udf("array<int>")
    def near(one: pd.Series, some: pd.Series) -> pd.Series:
        return pd.Series([ids[np.bitwise_count(((x ^ ones) & ~(x ^ y) & mask).view(np.uint64)) <= limit] for x, y in zip(one.to_numpy(np.int64), some.to_numpy(np.int64), strict=True)])

    met = packed.select("g", "grays", F.explode(near("ones", "some")).alias("h")).select(F.least("g", "h").alias("p"), F.greatest("g", "h").alias("q"), "g", "grays")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63) for x in pdf["grays"]]
        each = [x ^ (x >> np.uint64(1)) for x in each]
        top = forest(each[0], each[1] if len(each) > 1 else None, limit)
        fps = np.concatenate(each).view(np.int64)
        order = np.lexsort((fps, top))
        top, fps, at = top[order], fps[order], np.arange(len(order))
        start = np.maximum.accumulate(np.where(np.concatenate([[True], top[1:] != top[:-1]]), at, 0))
        up = start + (at - start - 1) // SPREAD
        child = at > start
        return pd.DataFrame({"a": fps[up[child]], "b": fps[child]})

    # pairs are few bytes and much work: their number, not their size, says how many tasks there are
    tasks = min(GROUPS, len(ids) * (len(ids) + 1) // 2)
    return met.repartition(tasks, "p", "q").groupBy("p", "q").applyInPandas(compare, "a long, b long")


def thin(edges: DataFrame) -> DataFrame:
    """Edges that connect what ``edges`` (a, b) do, with no a above SPREAD times: beyond, neighbours of a hang below each other."""
    ranked = cut(salted_rank(edges.distinct(), "a", [F.col("b")], "r", F.xxhash64("b")))
    up = ranked.select("a", F.col("r").alias("up"), F.col("b").alias("above"))
    far = ranked.where(F.col("r") >= SPREAD).withColumn("up", F.floor(F.col("r") / SPREAD) - 1)
    return ranked.where(F.col("r") < SPREAD).select("a", "b").unionByName(far.join(up, ["a", "up"]).select(F.col("above").alias("a"), "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round, every node takes the smallest label among its own and its neighbours', and then its label's label.
    Rounds end when no label moves. Edges of which one node has very many are best thinned first (``thin``).
    """
    pairs = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        seen = pairs.join(labels, pairs["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(seen, labels["node"] == seen["a"]).select("node", F.least("root", "m").alias("to"), F.col("root").alias("was"))
        up = labels.select(F.col("node").alias("to"), F.col("root").alias("higher"))
        new = cut(low.join(up, "to", "left").select("node", F.least("to", F.coalesce("higher", "to")).alias("root"), "was"))
        moved = not new.where("root <> was").isEmpty()
        labels = new.select("node", "root")
        if not moved:
            return labels


def group_fingerprints(rows: DataFrame, limit: int = 3) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``rows`` (doc_id, fp)."""
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(cut(links(distinct, limit)))
    rooted = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__ll_text"))
    rows = cut(with_fingerprint(own, "__ll_text", "fp", shingle).select("doc_id", "fp"))
    groups = group_fingerprints(rows, limit)
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, null ids last; of rows equal in id and text, one stays."""
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__ll_text"))
    rows = cut(with_fingerprint(own, "__ll_text", "fp", shingle).select("doc_id", F.xxhash64(F.coalesce("__ll_text", F.lit(""))).alias("h"), "fp"))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("kept")))
    labels = components(cut(links(distinct, limit)))
    rooted = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("kept", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("kept").alias("kept"))
    kept = kept.select(F.coalesce("kept.doc_id", F.lit(-(2**63))).alias("__ll_id"), F.col("kept.h").alias("__ll_h"))
    keyed = docs.withColumns({"__ll_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "__ll_h": h})
    return keyed.join(kept, ["__ll_id", "__ll_h"], "left_semi").dropDuplicates(["__ll_id", "__ll_h"]).select(*docs.columns)


def op10_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
