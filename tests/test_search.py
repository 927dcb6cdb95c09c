"""Searches through postings against a scan, lookups by key, and calibrated bands."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import scoring, search


def test_searches_equal_a_scan(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abAB cÄ") for _ in range(rng.randrange(0, 14))) for _ in range(300)] + [None, "", "NEFT-RAZORPAY"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    asked = ["ab", "aba", "b a", "razor", "ÄÄ", "a", "", "cccc", "NEFT-RAZORPAY SOFTWARE", "abab"]
    got = search.search(rows, search.postings(rows, "id", "t"), "id", "t", spark.createDataFrame([(a,) for a in asked], "wanted string")).collect()
    want = {(a, i) for a in asked for i, t in enumerate(texts) if t is not None and a.lower() in t.lower()}
    assert {(r["wanted"], r["id"]) for r in got} == want and len(got) == len(want)


def test_a_lookup_reads_one_bucket(spark):
    df = spark.range(1000).select(F.concat(F.lit("ord_"), "id").alias("order_id"), "id")
    t = search.store_by_key(df, "rows_by_key", "order_id", 8)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells
    one = t.where("order_id = 'ord_77'")
    assert one.first()["id"] == 77
    assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    spark.sql("DROP TABLE rows_by_key")


def test_the_interval_is_exact():
    tail = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    for right, n in ((1, 1), (0, 4), (7, 9), (49, 50), (13, 200)):
        lo, hi = scoring.exact_interval(right, n)
        assert lo == 0 if right == 0 else tail(right, n, lo) == pytest.approx(0.025, abs=1e-6)
        assert hi == 1 if right == n else 1 - tail(right + 1, n, hi) == pytest.approx(0.025, abs=1e-6)


def test_bands_against_the_truth_over_runs(spark):
    a = [("r1", "s1", "x", "STRONG"), ("r1", "s2", "y+z", "STRONG"), ("r1", "s3", "q", "STRONG"), ("r2", "s1", "x", "CIRCUMSTANTIAL"), ("r2", "s9", None, "REFUSE"), ("r2", "s4", "w", None)]
    t = [("r1", "s1", ["x"]), ("r1", "s2", ["z", "y"]), ("r1", "s3", []), ("r2", "s1", ["v"]), ("r3", "s1", ["v"])]
    told = spark.createDataFrame(a, "run string, settlement_id string, item_id string, band string")
    truth = spark.createDataFrame(t, "run string, settlement_id string, items array<string>")
    got = {r["band"]: r for r in scoring.calibration(told, truth).collect()}
    assert {k: (r["claims"], r["right"], r["wrong"], r["honest"]) for k, r in got.items()} == {"STRONG": (3, 2, 1, False), "CIRCUMSTANTIAL": (1, 0, 1, None)}
    assert (got["STRONG"]["low"], got["STRONG"]["high"]) == pytest.approx(scoring.exact_interval(2, 3))
    runs = {r["run"]: (r["gaps"], r["claims"], r["refused"]) for r in scoring.calibration_runs(told, truth).collect()}
    assert runs == {"r1": (3, 3, 0), "r2": (1, 1, 1), "r3": (1, 0, 0)}
