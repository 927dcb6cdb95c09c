"""Pairs are counted for every gap, however many chance would give."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from ledgerloom.operators import attribution

SCHEMA = "item_id string, kind string, magnitude long, item_settlement string"


def levels(spark, rows, gaps):
    g = spark.createDataFrame(gaps, "gap_id string, settlement_id string, delta long")
    return {r["gap_id"]: r for r in attribution.attribute(g, spark.createDataFrame(rows, SCHEMA), 2).collect()}


def test_round_amounts_leave_an_odd_gap_unexplained(spark):
    rows = [(f"r{i}", "refund", 100 * (1 + i % 50), f"s{i % 7}") for i in range(600)]
    got = levels(spark, rows, [("odd", "s1", 5050), ("even", "s1", 6000)])
    assert (got["odd"]["level"], got["odd"]["outcome"], got["odd"]["n_candidates"]) == ("L5", "AMOUNT_VARIANCE_UNEXPLAINED", 0)
    want = sum(a[2] + b[2] == 6000 for a, b in combinations([r for r in rows if r[3] != "s1"], 2))
    assert (got["even"]["level"], got["even"]["outcome"], got["even"]["n_candidates"]) == ("L4", "AMBIGUOUS_MULTI_CANDIDATE", want)


def test_counts_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = [(f"i{i}", rng.choice(["payment", "refund"]), rng.randrange(1, 400), rng.choice(["a", "b", "c", None])) for i in range(120)]
    gaps = [(f"g{k}", rng.choice(["a", "b", None]), rng.choice([-1, 1]) * rng.randrange(3, 900)) for k in range(40)]
    g = spark.createDataFrame(gaps, "gap_id string, settlement_id string, delta long")
    got = {r["gap_id"]: r["n_candidates"] for r in attribution.pair_counts(g, spark.createDataFrame(rows, SCHEMA), 2).collect()}
    for gap, s, delta in gaps:
        n = sum(abs(abs(delta) - a[2] - b[2]) <= 2 for a, b in combinations([r for r in rows if r[3] != s], 2))
        assert got.get(gap, 0) == n


def test_chance_of_pairs_is_exact(spark):
    rng = random.Random(5)
    items = [(f"i{k}", "payment", rng.choice([rng.randint(1, 400), rng.randint(1, 3_000_000)]), f"s{k % 4}") for k in range(60)]
    gaps = [(f"g{k}", f"s{k % 6}", rng.choice([-1, 1]) * rng.choice([3, 40, 500, 2_000_000, 5_900_000])) for k in range(20)]
    df = spark.createDataFrame(items, "item_id string, kind string, magnitude long, item_settlement string")
    got = {r["gap_id"]: r["chance"] for r in attribution.pair_chance(spark.createDataFrame(gaps, "gap_id string, settlement_id string, delta long"), df, 2).collect()}
    for gap, own, delta in gaps:
        pool = [m for _, _, m, s in items if s != own]
        t = abs(delta)
        lo = max(1, t // 2)
        hi = max(lo + 1, t * 3 // 2)
        want = sum(max(0, min(hi - 1, a + b + 2) - max(lo, a + b - 2) + 1) for a, b in combinations(pool, 2)) / (hi - lo)
        assert got.get(gap, 0.0) == pytest.approx(want, abs=1e-12), gap


def test_the_only_pair_is_looked_up(spark):
    items = [("a", 100, "s1"), ("b", 250, "s2"), ("c", 100, "s9"), ("d", 7000, "s1"), ("e", 7000, "s2"), ("f", 90_000, "s1"), ("g", 1, "s3"), ("h", 1, "s9")]
    df = spark.createDataFrame([(i, "payment", m, s) for i, m, s in items], "item_id string, kind string, magnitude long, item_settlement string")
    gaps = spark.createDataFrame([("x", "s9", 350), ("y", "s9", -14_001), ("z", "s9", 97_000), ("n", "s9", 50)], "gap_id string, settlement_id string, delta long")
    counts = attribution.pair_counts(gaps, df, 2)
    assert {r["gap_id"]: r["n_candidates"] for r in counts.collect()} == {"x": 1, "y": 1, "z": 2}
    assert {r["gap_id"]: r["item_id"] for r in attribution.only_pair(gaps, counts, df).collect()} == {"x": "a+b", "y": "d+e"}
    got = {r["gap_id"]: r for r in attribution.attribute(gaps, df).collect()}
    assert (got["x"]["level"], got["x"]["n_candidates"]) == ("L4", 1) and got["z"]["outcome"] == "AMBIGUOUS_MULTI_CANDIDATE" and got["n"]["level"] == "L5"


def test_shown_candidates_equal_all_items_without_meeting_them(spark, monkeypatch):
    rng = random.Random(6)
    kinds, settlements = ["payment", "refund", "chargeback"], ["a", "b", "c", None]
    items = [(f"i{k:03}", rng.choice(kinds), rng.choice([rng.randrange(-3, 60), rng.randrange(40, 44), rng.randrange(900, 2000)]), rng.choice(settlements)) for k in range(150)]
    items += [(f"o{k:03}", "chargeback", 700, "a") for k in range(30)] + [("p0", "chargeback", 698, "b")]  # most that fit are a's own
    gaps = [(f"g{k:02}", rng.choice(settlements), rng.choice([-1, 1]) * rng.choice([42, 700, rng.randrange(4, 1500)])) for k in range(60)] + [("g98", "a", 700), ("g99", None, 42)]
    monkeypatch.setattr(attribution, "single_candidates", lambda *a: pytest.fail("each gap meets each item that fits it"))
    g = spark.createDataFrame(gaps, "gap_id string, settlement_id string, delta long")
    got = {r["gap_id"]: (r["level"], [tuple(c) for c in r["candidates"]]) for r in attribution.shown_candidates(g, spark.createDataFrame(items, SCHEMA), 3).collect()}
    singles = 0
    for gap, s, delta in gaps:
        t = abs(delta)
        fit = [(attribution.LEVEL_OF[k], abs(t - m), i, k, m, t - m, own) for i, k, m, own in items if own != s and abs(t - m) <= 3 and t > 3]
        if fit:
            level = min(x[0] for x in fit)
            assert got[gap] == (level, [x[2:] for x in sorted(x for x in fit if x[0] == level)[:6]]), gap
            singles += 1
        elif t > 3:
            pairs = [(abs(t - a[2] - b[2]), "+".join(sorted((a[0], b[0])))) for a, b in combinations([x for x in items if x[3] != s], 2) if abs(t - a[2] - b[2]) <= 3]
            assert len(got.get(gap, (None, []))[1]) == min(6, len(pairs)) and all(abs(c[3]) == p[0] for c, p in zip(got.get(gap, (None, []))[1], sorted(pairs)))
    assert singles > 20 and len(got["g98"][1]) > 0
