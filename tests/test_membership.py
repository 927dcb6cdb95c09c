"""Credits made of unnamed payments: pools, searches and the odds of a chance fit, against every subset."""

from __future__ import annotations

import itertools
import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.config import Rates
from ledgerloom.functions.calendar import business_calendar
from ledgerloom.operators import membership as M
from tests.plain_reconcile import bps, later

START = date(2026, 6, 1)


def payout(some):
    gross = sum(x[1] for x in some)
    return gross - sum(x[2] + x[3] for x in some) - bps(gross, 100)


def every_subset(pool):
    return [s for k in range(1, len(pool) + 1) for s in itertools.combinations(pool, k)]


def ledger(seed):
    rng = random.Random(seed)
    payments = []
    for k in range(90):
        amount = rng.choice([rng.randrange(100, 4000), rng.randrange(10**5, 10**8)])
        fee = bps(amount, 200)
        payments.append((f"p{k:02}", amount, fee, bps(fee, 1800), datetime(2026, 6, 1) + timedelta(days=rng.randrange(25), hours=rng.randrange(24))))
    due = {p[0]: later(p[4].date() + timedelta(p[4].hour >= 23), 2, ()) for p in payments}
    credits = []
    for k in range(30):
        day = START + timedelta(rng.randrange(5, 30))
        some = [p for p in payments if due[p[0]] <= day <= later(due[p[0]], 3, ()) and rng.random() < 0.4]
        credits.append((f"b{k}", day, max(1, payout(some) + rng.choice([0, 1, -2, 7]))))
    credits.append(("none", START - timedelta(90), 10**6))
    return payments, due, credits


def brute(payments, due, credits):
    out = {}
    for b, day, paid in credits:
        pool = [p for p in payments if due[p[0]] <= day <= later(due[p[0]], 3, ()) and p[1] - p[2] - p[3] - bps(p[1], 100) <= paid + 2]
        out[b] = (len(pool), pool)
    return out


@pytest.mark.parametrize("seed", [1])
def test_pools_and_answers(spark, seed):
    payments, due, credits = ledger(seed)
    p = spark.createDataFrame(payments, "payment_id string, amount_paise long, fee_paise long, tax_paise long, ts timestamp")
    c = spark.createDataFrame(credits, "bank_row_id string, event_date date, credit_paise long").withColumn("like", F.when(F.col("bank_row_id") == "b3", 40.0).otherwise(100.0))
    cal = business_calendar(spark, date(2026, 1, 1), date(2026, 12, 31))
    got = {r["bank_row_id"]: r for r in M.memberships(c, p, cal, Rates(holidays=()), F.col("like"), cap=300).collect()}
    pools = brute(payments, due, credits)
    most = M.largest_pool(300)
    assert most == 14 and len(got) == len(credits) and got["b3"]["outcome"] == "SKIPPED_NOT_PAYOUT_SHAPED"
    seen = set()
    for b, _, paid in credits:
        n, pool = pools[b]
        if b == "b3":
            continue
        assert got[b]["pool_size"] == n, b
        seen.add(got[b]["outcome"])
        if n == 0:
            assert got[b]["outcome"] == "NO_SUBSET_FOUND"
        elif n > most:
            assert got[b]["outcome"].startswith("UNKNOWN") and got[b]["n_solutions"] == 0
        elif got[b]["outcome"] != "UNKNOWN_POOL_TOO_LARGE":
            fit = [s for s in every_subset(pool) if abs(paid - payout(s)) <= 2]
            assert got[b]["n_solutions"] == len(fit)
            assert {tuple(sorted(s)) for s in got[b]["solutions"]} <= {tuple(x[0] for x in s) for s in fit}
        else:
            assert got[b]["expected"] >= 1
    assert {"MEMBERSHIP_SOLVED", "NO_SUBSET_FOUND"} <= seen and any(o.startswith("UNKNOWN") for o in seen)


def test_chance_equals_enumeration():
    rng = np.random.default_rng(3)
    for n in range(1, 17):
        net = rng.integers(1, 5000, n)
        halves = M.Halves(net, net)
        sums = np.array([net[[i for i in range(n) if m >> i & 1]].sum() for m in range(1 << n)])
        for target in rng.integers(1, int(net.sum()) + 2, 5).tolist():
            width = max(1, int(net.sum()) // M.STRETCHES)
            lo, hi = target - width // 2, target + width // 2
            assert halves.chance(target, 2) == pytest.approx(((sums >= lo) & (sums <= hi)).sum() * 5 / (hi - lo + 1))
    assert M.Halves(np.zeros(2, int), np.zeros(2, int)).chance(5, 2) == math.inf


def test_the_normal_curve_is_near_the_count_in_large_pools(spark):
    rng = np.random.default_rng(4)
    net = rng.integers(1000, 90000, 30)
    halves, mid = M.Halves(net, net), int(net.sum() // 2)
    row = spark.createDataFrame([(30, float(net.sum()), float((net.astype(float) ** 2).sum()), mid)], "n long, t double, q double, x long")
    log2 = row.select(M.log2_chance(F.col("n"), F.col("t"), F.col("q"), F.col("x"), 2)).first()[0]
    assert log2 == pytest.approx(math.log2(halves.chance(mid, 2)), abs=0.2)


def test_reliability_of_answers(spark):
    rng = random.Random(9)
    rows = [(f"p{k:03}", f"s{k // 6}", a := rng.choice([rng.randrange(100, 2000), rng.randrange(10**5, 10**6)]), bps(a, 200), 0) for k in range(120)]
    p = spark.createDataFrame(rows, "payment_id string, settlement_id string, amount_paise long, fee_paise long, tax_paise long")
    pools = {}
    for r in M.probes(p, (4, 7, 10)).collect():
        pools.setdefault(r["probe"], []).append(r)
    assert len(pools) == 60 and all(len(v) == v[0]["pool_size"] == len({r["payment_id"] for r in v}) and sum(r["inside"] for r in v) == 4 for v in pools.values())
    want = {}
    for v in pools.values():
        plain = [(r["payment_id"], r["amount_paise"], r["fee_paise"], r["tax_paise"]) for r in v]
        true = {r["payment_id"] for r in v if r["inside"]}
        credit = payout([x for x in plain if x[0] in true])
        fit = [{x[0] for x in s} for s in every_subset(plain) if abs(credit - payout(s)) <= 2]
        w = want.setdefault(v[0]["pool_size"], [0, 0, 0, 0])
        w[0] += 1
        w[1] += true in fit
        w[2] += len(fit) == 1 and fit[0] == true
        w[3] += len(fit)
    curve = M.reliability(p, 100, sizes=(4, 7, 10, 60))
    got = {r["pool_size"]: r for r in curve.collect()}
    assert {k: [r["tried"], r["truth_found"], r["right"], r["subsets"]] for k, r in got.items() if k < 60} == want
    assert (got[60]["cap_hits"], got[60]["computable"], got[60]["reliability"]) == (20, 0, None)
    clean = [k for k in sorted(want) if got[k]["reliability"] == 1.0 and got[k]["solved"] >= 5]
    assert M.ceiling(curve).first()["ceiling"] in clean


def test_pools_searched_at_once_equal_their_halves(spark):
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 6, 10):
        gross = rng.integers(-20 if n == 2 else 1, 60 if n > 3 else 4000, (40, n))
        net = gross - (gross // 50)
        pick = rng.random((40, n)) < 0.5
        credit = (net * pick).sum(1) - np.round((gross * pick).sum(1) / 100).astype(int)
        for refuse in (True, False):
            expected, found, kept = M.small_pools_at_once(credit, gross, net, 100, 2, 3, refuse)
            for k in range(40):
                halves = M.Halves(gross[k], net[k])
                assert expected[k] == halves.chance(int(credit[k]), 2)
                want = halves.solutions(int(credit[k]), 100, 2, 3) if not refuse or expected[k] < 1 else (0, [])
                assert (found[k], kept[k]) == want
    sizes = [1, 2, 11, 12, 3] * 8  # of either kind, in one task
    rows = [(f"b{k}", f"p{k}/{i:02}", int(x)) for k, n in enumerate(sizes) for i, x in enumerate(rng.integers(1000, 10**6, n))]
    df = spark.createDataFrame(rows, "bank_row_id string, payment_id string, amount_paise long").withColumns({"fee_paise": F.lit(0), "tax_paise": F.lit(0)})
    whole = df.groupBy("bank_row_id").agg((F.sum("amount_paise") - F.floor((F.sum("amount_paise") * 100 + 5000) / 10000)).alias("credit_paise"))
    told = {r["bank_row_id"]: r for r in M.searched(df.join(whole, "bank_row_id").repartition(1), 100, refuse=False).collect()}
    assert len(told) == len(sizes)
    for k, n in enumerate(sizes):
        assert told[f"b{k}"]["pool_size"] == n and [f"p{k}/{i:02}" for i in range(n)] in told[f"b{k}"]["solutions"]
