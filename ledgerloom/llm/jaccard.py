"""Near-duplicate groups by SimHash fingerprints and by the exact Jaccard similarity of word shingles.

Two texts are linked if op10 links them, their fingerprints of three-word shingles being ``limit`` bits apart or less
(``simhash.links``), or if their sets of shingles have a similarity of ``least`` or more; groups are the connected
components of the links of both kinds. No pair is left out of either: the Gray-order index is exact, and in any common
order of the shingles, two similar sets share one of the first n - ceil(least * n) + 1 of each, so texts meet at these
only, and each meeting is checked on the whole sets. The order puts shingles that a sample holds often last and is by
hash otherwise; it decides what is compared, not what is linked.

Neither kind holds the other: two sets of similarity 0.8 differ in 9 to 10 of 64 bits on average, and no mask of a
Gray-ordered group shares enough bits to prune at that; long texts with edits all over can be 3 bits apart at less than 0.8.

Texts with equal sets are one class and are compared once; a class has the fingerprints of all its texts. The
fingerprints' links are taken first. Pairs for the sets are then proposed in two rounds: by each set's smallest hashes
and by the class that leads others at a shingle, and, for classes that are still in different groups, by every meeting:
near copies are in one group by then, so that a large group of them isn't compared pair by pair.

Before texts are fetched, a proposed pair's sketches (each set's SKETCH smallest hashes) are compared: a pair of the
wanted similarity falls below the bound with a chance of MISS at most. What is left is checked on the whole sets.

Texts with fewer words than a shingle have one shingle of all their words; null and empty texts and those without
words are one class. Shingles and classes are told apart by 64-bit hashes. Texts are read whole, however long. Other
columns are carried along untouched; names that begin with ``__ll_`` are this package's own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, small_batches, stored
from ledgerloom.llm.simhash import LOWER, WORD, components, fingerprint, links, thin

#: One text in so many is in the sample that orders the shingles, how often a shingle counts as common there, and the most that do.
PART, COMMON, MOST = 8, 4, 1 << 20
#: Hashes in a sketch, and the chance that a pair at the least similarity is dropped by its sketches.
SKETCH, MISS = 48, 1e-12
#: Smallest hashes at which sets are compared with one other before they are compared at their rare shingles.
FIRST = 4
#: Texts whose shingles a task holds at once.
STEP = 256
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(2**63)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = WORD.findall((text or "").translate(LOWER))
    h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    size = min(size, len(h))
    if not size:
        return np.zeros(0, np.int64)
    mixed = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        mixed = mixed * FACTOR + h[k : len(h) - size + 1 + k]
    return np.unique(mixed.view(np.int64))


def needed(n, least: float):
    """The least overlap of a set of n with any set of similarity ``least`` (rounded down where floats are in doubt)."""
    return np.ceil(n * least - 1e-9).astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63)


def marked(own: DataFrame, shingle: int, mark: int) -> DataFrame:
    """(c, fp, kept, sketch): each class with each SimHash fingerprint (of ``mark``-word shingles) of its texts, the first
    row of these (none, doc_id, h), and the class's sketch."""

    @F.pandas_udf("c long, fp long, sketch binary")
    def described(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            s = shingles(text, shingle)
            rows.append((class_of(s), fingerprint(text, mark), (s[:SKETCH] >> 32).astype("<i4").tobytes()))
        return pd.DataFrame(rows, columns=["c", "fp", "sketch"])

    rows = own.select("doc_id", F.xxhash64("text").alias("h"), described("text").alias("d"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("kept")
    return stored(rows.groupBy(F.col("d.c").alias("c"), F.col("d.fp").alias("fp")).agg(first, F.max("d.sketch").alias("sketch")))


def classes_of(marks: DataFrame) -> DataFrame:
    """(c, kept, sketch): each class, its first row and its sketch."""
    return stored(marks.groupBy("c").agg(F.min("kept").alias("kept"), F.max("sketch").alias("sketch")))


def common(own: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of the shingles that the sample's texts hold most often; at most MOST."""

    def spelled(batches):
        for pdf in batches:
            for at in range(0, len(pdf), STEP):
                yield pd.DataFrame({"t": np.concatenate([shingles(t, shingle) for t in pdf["text"][at : at + STEP]])})

    seen = own.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0).select("text").mapInPandas(spelled, "t long").groupBy("t").count().where(F.col("count") >= COMMON)
    return np.sort(seen.orderBy(F.desc("count"), "t").limit(MOST).select("t").toPandas()["t"].to_numpy(np.int64))


def meetings(own: DataFrame, often: np.ndarray, shingle: int, least: float) -> DataFrame:
    """(t, c, n, i, lead): the classes that meet at shingle t, their sizes and t's place in each, and the lead (share, c, n, i).

    The lead of a shingle is the class of which the greatest share of these shingles is met by others: an original among its
    edited copies, which differ from each other more than from it.
    """

    def heads(batches):
        seen, out = set(), []  # each task sends a class once
        for text in (t for pdf in batches for t in [*pdf["text"], None]):
            if text is None or len(out) >= STEP:  # the end of a batch, or enough for one of the output
                if out:
                    yield pd.DataFrame(dict(zip("tcni", map(np.concatenate, zip(*out, strict=True)), strict=True)))
                out = []
            s = shingles(text, shingle)
            c = class_of(s)
            if c not in seen and len(s):
                seen.add(c)
                late = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s if len(often) else np.zeros(len(s), bool)
                k = len(s) - int(needed(np.int64(len(s)), least)) + 1
                s = np.concatenate([s[~late], s[late]])[:k]
                out.append((s, np.full(k, c), np.full(k, len(late)), np.arange(k)))

    at = W.partitionBy("t")
    met = own.select("text").mapInPandas(heads, "t long, c long, n long, i long").withColumns({"first": F.min("c").over(at), "last": F.max("c").over(at)})
    met = stored(met.where("first <> last").drop("first", "last").dropDuplicates(["t", "c"]))
    n = F.max("n")
    share = met.groupBy("c").agg((F.count("*") / (n - F.ceil(n * least - 1e-9) + 1)).alias("share"))
    return stored(met.join(share, "c").withColumn("lead", F.max(F.struct("share", "c", "n", "i")).over(at)).drop("share"))


def can_be(n: str, i: str, m: str, j: str, least: float) -> Column:
    """Whether sets of n and m whose first common shingle is at i and j can be similar enough."""
    n, i, m, j = F.col(n), F.col(i), F.col(m), F.col(j)
    overlap = F.least(n - i, m - j)
    return (overlap * (1 + least) + 1e-6 >= (n + m) * least) & (n >= m * least - 1e-6) & (m >= n * least - 1e-6)


def least_hits(seen: int, least: float) -> int:
    """The most hits among ``seen`` draws that a share of ``least`` undercuts with a chance of MISS at most."""
    chance, hits = 0.0, 0
    while hits < seen and (chance := chance + math.comb(seen, hits) * least**hits * (1 - least) ** (seen - hits)) <= MISS:
        hits += 1
    return hits


def promising(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches leave the similarity possible; where they hold the whole union, it is known."""
    bound = [least_hits(k, least) for k in range(SKETCH + 1)]

    @F.pandas_udf("boolean")
    def possible(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            both, times = np.unique(np.concatenate([np.frombuffer(x, "<i4"), np.frombuffer(y, "<i4")]), return_counts=True)
            hits = int((times[:SKETCH] > 1).sum())
            out.append(hits >= bound[min(len(both), SKETCH)])
        return pd.Series(out, dtype="bool")

    one = lambda c, out: classes.select(F.col("c").alias(c), F.col("sketch").alias(out))
    return stored(pairs.join(one("a", "left"), "a").join(one("b", "right"), "b").where(possible("left", "right")).select("a", "b"))


def verified(pairs: DataFrame, own: DataFrame, classes: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is ``least`` or more."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        sets, out = {}, []
        for x, y in zip(left, right, strict=True):
            if len(sets) >= STEP:
                sets.clear()
            sets.update((t, shingles(t, shingle)) for t in (x, y) if t not in sets)
            out.append(similarity(sets[x], sets[y]) >= least)
        return pd.Series(out, dtype="bool")

    pairs = promising(pairs, classes, least)
    ends = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    # stored, so that its size is known: texts stay where they are while it can be sent to them
    keys = stored(classes.join(ends, "c").select("c", F.coalesce("kept.doc_id", F.lit(NO_ID)).alias("k"), F.col("kept.h").alias("h")))
    texts = own.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.xxhash64("text").alias("h"), "text").join(keys, ["k", "h"])
    texts = stored(texts.select("c", "text").dropDuplicates(["c"]))
    wide = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("left")), "a")
    wide = wide.join(texts.select(F.col("c").alias("b"), F.col("text").alias("right")), "b")
    return cut(wide.where(alike("left", "right")).select("a", "b"))


def close(marks: DataFrame, limit: int) -> DataFrame:
    """(a, b), a < b: links of classes that connect what fingerprints within ``limit`` bits do; those of one fingerprint
    through the smallest."""
    first = marks.groupBy("fp").agg(F.min("c").alias("first"))
    same = marks.join(first, "fp").where("c <> first").select(F.col("first").alias("a"), F.col("c").alias("b"))
    to = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}c"))
    near = links(first.select("fp"), limit).join(to("a"), "a").join(to("b"), "b").where("ac <> bc")
    return cut(same.unionByName(near.select(F.least("ac", "bc").alias("a"), F.greatest("ac", "bc").alias("b"))).distinct())


def proposed(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: each class with the smallest class that has one of its FIRST smallest hashes there, too."""
    small = classes.select("c", F.explode(F.array(*[F.substring("sketch", 4 * k + 1, 4) for k in range(FIRST)])).alias("s")).where(F.length("s") == 4)
    leads = small.groupBy("s").agg(F.min("c").alias("a"), F.max("c").alias("last")).where("a <> last").drop("last")
    return small.join(leads, "s").where("a <> c").select("a", F.col("c").alias("b"))


def groups(own: DataFrame, marks: DataFrame, classes: DataFrame, shingle: int, least: float, limit: int) -> DataFrame:
    """(node, root): for each class that is linked to another, the smallest class of its group."""
    near = close(marks, limit)
    met = meetings(own, common(own, shingle), shingle, least)
    stars = met.where(F.col("c") != F.col("lead.c")).where(can_be("n", "i", "lead.n", "lead.i", least))
    stars = stars.select(F.least("lead.c", "c").alias("a"), F.greatest("lead.c", "c").alias("b")).unionByName(proposed(classes)).distinct()
    stars = stored(stars.join(near, ["a", "b"], "left_anti"))
    linked = cut(thin(verified(stars, own, classes, shingle, least).unionByName(near)))
    labels = components(linked)
    told = met.drop("lead").join(labels, met["c"] == labels["node"], "left").select("t", "c", "n", "i", F.coalesce("root", "c").alias("r"))
    x, y = told.alias("x"), told.alias("y")
    rest = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.c") < F.col("y.c")) & (F.col("x.r") != F.col("y.r")) & can_be("x.n", "x.i", "y.n", "y.i", least))
    rest = stored(rest.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"))
    return components(linked.unionByName(verified(rest, own, classes, shingle, least)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, mark: int = 3, limit: int = 3) -> DataFrame:
    """``docs`` with one row of each group: the smallest id, null ids last; of rows equal in id and text, one stays."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        marks = marked(own, shingle, mark)
        classes = classes_of(marks)
        labels = groups(own, marks, classes, shingle, least, limit)
    rooted = classes.join(labels, classes["c"] == labels["node"], "left").select("kept", F.coalesce("root", "c").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("kept").alias("kept"))
    kept = kept.select(F.coalesce("kept.doc_id", F.lit(NO_ID)).alias("__ll_id"), F.col("kept.h").alias("__ll_h"))
    keyed = docs.withColumns({"__ll_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__ll_h": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return keyed.join(kept, ["__ll_id", "__ll_h"], "left_semi").dropDuplicates(["__ll_id", "__ll_h"]).select(*docs.columns)
