"""The library's own operators: unit vectors, branches, and every query against its SQL."""

from __future__ import annotations

import itertools
import math
import random
from datetime import date
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom import finding_queries as queries
from ledgerloom.config import Rates
from ledgerloom.functions import calendar as cal
from ledgerloom.functions import money, text
from ledgerloom.operators import attribution, batches, matching, membership



@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return str(x) if isinstance(x, date) else x


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, tiny, duck, name):
    got = queries.QUERIES[name](spark, tiny)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda rs: sorted((tuple(map(plain, r)) for r in rs), key=repr)
    assert rows(got.select(*[F.col(f"`{c}`") for c in columns]).collect()) == rows(want.fetchall())


def test_money(spark):
    df = spark.createDataFrame([("3464.00", 346400), ("0.99", 99), ("-12.34", -1234), ("105040.27", 10504027)], "s string, p long")
    assert df.where(money.parse_paise(F.col("s")) != F.col("p")).count() == 0
    fees = spark.createDataFrame([(346400, 200, 6928), (6928, 1800, 1247), (50, 100, 1), (7, 0, 0)], "p long, bps int, fee long")
    assert [r[0] for r in fees.select(money.apply_bps(F.col("p"), F.col("bps")) == F.col("fee")).collect()] == [True] * 4


def test_business_days(spark):
    c = cal.business_calendar(spark, date(2026, 6, 1), date(2026, 9, 1), [date(2026, 8, 15)])
    df = spark.createDataFrame([(date(2026, 7, 1), date(2026, 7, 3)), (date(2026, 7, 2), date(2026, 7, 6)), (date(2026, 7, 4), date(2026, 7, 8))], "d date, e date")
    assert all(r["e"] == r["x"] for r in cal.add_business_days(df, c, "d", 2, "x").collect())


def test_references(spark):
    df = spark.createDataFrame([("NEFT CR-RATN0000088-RAZORPAY SOFTWA", None), ("IMPS/CHIE619237245018/RAZORPAY SOFT", "CHIE619237245018"), ("", None), (None, None)], "n string, u string")
    assert df.where(~text.extract_utr(F.col("n")).eqNullSafe(F.col("u"))).count() == 0


def test_carry_forward_equals_the_recurrence(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.randint(-50, 60)) for k in range(3) for t in range(40)]
    got = {(r["k"], r["t"]): r for r in batches.carry_forward(spark.createDataFrame(rows, "k int, t int, raw long"), ["k"], ["t"], "raw").collect()}
    for k in range(3):
        carry = 0
        for _, t, raw in (r for r in rows if r[0] == k):
            assert got[k, t]["carry_in"] == carry and got[k, t]["payout"] == max(0, raw - carry)
            carry = max(0, carry - raw)
            assert got[k, t]["carry_out"] == carry


def test_next_cycle_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(rng.randint(0, 2), i, rng.randint(0, 30)) for i in range(60)]
    cycles = [(rng.randint(0, 2), i, rng.randint(0, 30)) for i in range(20)]
    got = {r["i"]: r["c"] for r in batches.next_cycle(spark.createDataFrame(items, "k int, i int, d int"), spark.createDataFrame(cycles, "k int, c int, d int"), "k", "i", "d", "d", "c").collect()}
    for k, i, d in items:
        assert got[i] == min(((x, c) for kk, c, x in cycles if kk == k and x >= d), default=(0, None))[1]


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    items = [(f"i{k:02}", "refund", rng.randint(1, 500), rng.choice(["s1", "s2", None])) for k in range(40)]
    gaps = [("g1", "s1", 300), ("g2", "s2", -700), ("g3", "s3", 41)]
    i = spark.createDataFrame(items, "item_id string, kind string, magnitude long, item_settlement string")
    g = spark.createDataFrame(gaps, "gap_id string, settlement_id string, delta long")
    got = {(r["gap_id"], r["item_a"], r["item_b"]) for r in attribution.pair_candidates(g, i, 2).collect()}
    want = {(gap, a[0], b[0]) for gap, s, d in gaps for a, b in itertools.combinations(items, 2) if a[3] != s and b[3] != s and abs(abs(d) - a[2] - b[2]) <= 2}
    assert got == want
    single = {(r["gap_id"], r["item_id"]) for r in attribution.single_candidates(g, i, 2).collect()}
    assert single == {(gap, a[0]) for gap, s, d in gaps for a in items if a[3] != s and abs(abs(d) - a[2]) <= 2}


def test_membership_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in range(6):
        pays = [(f"p{c}{k}", rng.randint(100, 9000)) for k in range(7)]
        inside = [a for _, a in pays[: rng.randint(1, 7)]]
        credit = sum(inside) - (sum(inside) * 100 + 5000) // 10000
        rows += [(f"b{c}", credit, p, a, 0, 0) for p, a in pays]
    df = spark.createDataFrame(rows, "bank_row_id string, credit_paise long, payment_id string, amount_paise long, fee_paise long, tax_paise long")
    for r in membership.infer_membership(df, Rates().withholding_bps, refuse=False).collect():
        own = [x for x in rows if x[0] == r["bank_row_id"]]
        n = 0
        for k in range(1, 8):
            for some in itertools.combinations(own, k):
                g = sum(x[3] for x in some)
                n += abs(own[0][1] - (g - (g * 100 + 5000) // 10000)) <= 2
        assert r["n_solutions"] == n


def test_contested_pairs_are_no_ones(spark):
    df = spark.createDataFrame([("s1", "b1"), ("s2", "b1"), ("s3", "b3"), ("s3", "b4"), ("s5", "b5")], "s string, b string")
    assert [r["s"] for r in matching.mutual_unique(df, "s", "b").where("unique").collect()] == ["s5"]
