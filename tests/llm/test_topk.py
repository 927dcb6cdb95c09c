from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm.topk import layout, masks, top_k

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def brute(rows, is_query, k):
    vectors = {}
    for vec_id, v, *_ in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) for x in v]
        vectors[vec_id] = min(v, vectors.get(vec_id, v))
    out = []
    for q, v in vectors.items():
        if is_query(q):
            found = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in vectors.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def check(spark, rows, k=5, every=7, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % every == 0, k=k, **options).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, lambda i: i % every == 0, k)


def test_matches_brute_force_with_ties_and_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], "x", "y") for i in range(220)]
    rows += [(300 + i, rows[7][1], "x", "y") for i in range(40)]  # one hot vector, with a query among its copies
    rows += [(350 + i, [0.0] * 8, None, None) for i in range(3)]
    rows += [(400, None, "", ""), (401, [1.0, None], "", ""), (402, [float("nan")], "", ""), (406, [float("inf")] * 8, "", ""), (None, [1.0] * 8, "", "")]
    rows += [rows[0], (14, [9.0] * 8, "again", "")]  # a repeated row, and an id with two vectors
    check(spark, rows, pivots=6, sample=100)
    check(spark, rows, pivots=6, sample=100, block=8)  # annuli of several blocks, and blocks of several annuli


def test_layout_covers_every_annulus_once():
    sizes = np.array([3, 3, 20, 1, 1, 9, 0, 4])
    at = layout(sizes, 8)
    assert at.tolist() == [[0, 1, 0], [0, 1, 1], [1, 3, 0], [4, 1, 0], [4, 1, 1], [5, 2, 0], [7, 1, 0], [7, 1, 1]]
    sent = {(m["block"], j) for m in masks(at[[1, 2, 7]]) for j in np.flatnonzero(np.unpackbits(np.frombuffer(m["opens"], np.uint8)))}
    assert sent == {(0, 1), (1, 0), (2, 0), (3, 0), (7, 1)} and masks(at[:0]) == []


def test_clustered_vectors_need_few_annuli_and_stay_exact(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        c = i % 5
        rows.append((i, [(8.0 if d == c else 0.0) + rng.gauss(0, 0.1) for d in range(6)], "", ""))
    check(spark, rows, k=3, every=10, pivots=5, sample=64)


def test_fewer_vectors_than_k_and_none(spark):
    check(spark, [(0, [1.0, 2.0], "", ""), (1, [3.0], "", ""), (2, [], "", "")])
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 7 == 0).count() == 0
    assert top_k(spark.createDataFrame([(0, None, "", "")], SCHEMA), F.col("vec_id") % 7 == 0).count() == 0
