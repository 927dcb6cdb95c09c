"""Payouts identified by an explained gap, both ways, against every payout with every credit and every pair of items."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta
from itertools import combinations

import pytest

from ledgerloom import config as C
from ledgerloom.operators import attribution as A
from ledgerloom.operators.chance import CELLS, chance_floors
from ledgerloom.operators.identify import identified
from tests.plain_reconcile import chance, explain

ITEM = "item_id string, kind string, magnitude long, item_settlement string"
START = date(2026, 6, 1)


def ledger(seed):
    rng = random.Random(seed)
    big = lambda: rng.choice([rng.randrange(1, 4000), rng.randrange(4000, 10**6), rng.randrange(10**6, 10**9)])
    items = [(f"i{k}", rng.choice(["payment", "refund", "chargeback"]), big(), rng.choice(["s1", "s2", "s9", None])) for k in range(70)]
    items += [(f"h{k}", "payment", 777, "s9") for k in range(40)]  # a common amount
    batches, credits = [], []
    for k in range(60):
        day, net = START + timedelta(rng.randrange(20)), rng.randrange(10**6, 10**9)
        batches.append((f"s{k}", net, day, day + timedelta(4)))
        cause = rng.choice([rng.choice(items[:70])[2], sum(x[2] for x in rng.sample(items[:70], 2)), rng.choice(items)[2]])
        credits.append((f"b{k}", day + timedelta(rng.randrange(7)), max(1, net + rng.choice([-1, -1, 1]) * cause + rng.randrange(-2, 4))))
    return items, batches, credits


def brute(items, batches, credits):
    pool = [{"item_id": i, "kind": k, "magnitude": m, "settlement_id": s} for i, k, m, s in items]
    out = {}
    for s, net, first, last in batches:
        for b, day, paid in credits:
            if first <= day <= last:
                e = explain(net - paid, s, pool)
                if e["outcome"] == "ATTRIBUTED" and e["expected"] < C.STRONG_MAX:
                    out[s, b] = (e["level"], e["item_id"])
    return out


def run(spark, items, batches, credits, way):
    b = spark.createDataFrame(batches, "settlement_id string, expected_net_paise long, event_date date, hi date")
    c = spark.createDataFrame(credits, "bank_row_id string, event_date date, credit_paise long")
    return {(r["settlement_id"], r["bank_row_id"]): (r["level"], r["item_id"]) for r in identified(b, c, spark.createDataFrame(items, ITEM), way=way).collect()}


@pytest.mark.parametrize("seed", [1])
def test_both_ways_equal_every_payout_with_every_credit(spark, seed):
    items, batches, credits = ledger(seed)
    want = brute(items, batches, credits)
    assert {"L4"} < {level for level, _ in want.values()}
    assert run(spark, items, batches, credits, "day") == run(spark, items, batches, credits, "cause") == want


def test_one_large_order_blurs_no_small_amounts(spark):
    """Two small items explain a gap beside forty larger ones and one of a thousand million; its exact chance is low."""
    items = [("a", "refund", 1000, "x"), ("b", "refund", 2000, "x"), *[(f"p{k}", "payment", 200000 + 37 * k, "x") for k in range(40)], ("huge", "payment", 10**9, "x")]
    batches = [("s1", 900000, START, START + timedelta(3))]
    credits = [("bank_1", START + timedelta(1), 897000), ("bank_2", START + timedelta(9), 897000)]
    for way in ("day", "cause", None):
        assert run(spark, items, batches, credits, way) == {("s1", "bank_1"): ("L4", "a+b")}
    told = A.attribute(spark.createDataFrame([("g", "s1", 3000)], "gap_id string, settlement_id string, delta long"), spark.createDataFrame(items, ITEM)).first()
    assert (told["outcome"], told["item_id"], told["n_candidates"], told["band"]) == ("ATTRIBUTED", "a+b", 1, "STRONG")


def test_floors_are_never_above_the_chance(spark):
    rng = random.Random(6)
    items = [(f"d{k}", rng.choice(["payment", "refund"]), rng.choice([rng.randrange(1, 3000), rng.randrange(1, 90000)]), rng.choice(["s1", "s2", *[f"t{j}" for j in range(40)]])) for k in range(300)]
    floors = chance_floors(spark.createDataFrame(items * 2, ITEM), 2)  # repeated rows count once
    for _ in range(120):
        t = int(2 ** rng.uniform(2, 17.5))
        own = rng.choice(["s1", "s2", "t3", "other"])
        pool = [(k, m) for _, k, m, s in items if s != own]
        cell = int(CELLS * math.log2(t))
        sums = [a[1] + b[1] for a, b in combinations(pool, 2)]
        if cell < len(floors.pair):
            assert floors.pair[cell] <= chance(t, sums, 2) + 1e-9
            for kind, low in floors.single.items():
                assert low[cell] <= chance(t, [m for k, m in pool if k == kind], 2) + 1e-9
    assert max(floors.pair) > 1 and max(floors.single["payment"]) > 0.01


def test_empty_ledgers(spark):
    items, batches, credits = ledger(3)
    assert run(spark, [], batches, credits, None) == run(spark, items, [], credits, "cause") == run(spark, items, batches, [], None) == {}
