"""Each check fails on ledgers that break its rule, and on no others; curves against a plain count."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import exceptions, scoring
from ledgerloom.plans import queue, validate
from ledgerloom.sources.ledgers import Ledgers
from ledgerloom.sources.star import star_ledgers


@pytest.fixture(scope="module")
def sound(spark, tiny, tmp_path_factory):
    """The star ledgers without what they break by design, as files."""
    l = star_ledgers(spark, tiny)
    folder = tmp_path_factory.mktemp("ledgers")
    tables = {}
    for t in validate.KEYS:
        getattr(l, t).write.parquet(f"{folder}/{t}")
        tables[t] = spark.read.parquet(f"{folder}/{t}")
    return Ledgers(**tables)


def failures(l):
    return {(r["section"], r["check"]): r["failures"] for r in validate.ledger_checks(l).collect()}


def test_each_broken_rule_is_counted(spark, sound):
    before = failures(sound)
    first = sound.settlements.orderBy("settlement_id").first()["settlement_id"]
    bump = lambda df, where, column, by: df.withColumn(column, F.col(column) + F.when(where, by).otherwise(0))
    here = F.col("settlement_id") == first
    broken = replace(
        sound,
        orders=sound.orders.unionByName(sound.orders.orderBy("order_id").limit(2)),
        settlements=bump(bump(sound.settlements, here, "net_paise", 1), here, "withholding_paise", 3),
        bank=sound.bank.withColumn("debit_paise", F.when(F.col("credit_paise") > 0, 5).otherwise(F.col("debit_paise"))),
        refunds=sound.refunds.withColumn("payment_id", F.lit("pay_none")),
    )
    after = failures(broken)
    assert after["identity", "orders_unique"] == before["identity", "orders_unique"] + 2
    assert after["cycles", "withholding"] == before["cycles", "withholding"] + 1
    assert after["cycles", "equation"] == before["cycles", "equation"] + 1
    assert after["bank", "one_sided"] == sound.bank.where("credit_paise > 0").count()
    assert after["references", "refunds_payment_id"] == sound.refunds.count()
    assert set(k for k in after if after[k] != before[k]) <= {("identity", "orders_unique"), ("cycles", "withholding"), ("cycles", "equation"), ("cycles", "below_gross"), ("bank", "one_sided"), ("references", "refunds_payment_id"), ("references", "refunded_and_disputed"), ("dates", "refunds_after_capture")}


def test_empty_ledgers_pass(spark, sound):
    empty = Ledgers(**{t: getattr(sound, t).limit(0) for t in validate.KEYS})
    rows = validate.summary(validate.ledger_checks(empty)).collect()
    assert all(r["checks"] == r["passed"] and r["failures"] == 0 for r in rows) and len(rows) == 6


def test_terms_leave_out_reversals_of_zero(spark):
    df = spark.createDataFrame([("a", 100, 2, 1, 1, 0, 7, 0), ("b", None, None, None, None, None, None, 4)], "settlement_id string, gross_paise long, fee_paise long, tax_paise long, withholding_paise long, refund_paise long, chargeback_paise long, carry_forward_in_paise long")
    got = [(r["settlement_id"], r["place"], r["label"], r["paise"]) for r in queue.arithmetic(df).orderBy("settlement_id", "place").collect()]
    assert got[:5] == [("a", 0, "payments", 100), ("a", 1, "fee", -2), ("a", 2, "tax", -1), ("a", 3, "withholding", -1), ("a", 4, "chargebacks", -7)]
    assert got[5:] == [("b", 0, "payments", 0), ("b", 1, "fee", 0), ("b", 2, "tax", 0), ("b", 3, "withholding", 0), ("b", 4, "carried in", -4)]


def test_curves_and_their_limits(spark):
    pairs = spark.createDataFrame([("r", "k1", 0), ("r", "k1", 5), ("r", "k2", -1), ("q", "k3", 0)], "run string, key string, delta long")
    totals = spark.createDataFrame([("r", 2), ("q", 1), ("none", 3)], "run string, total long")
    curves = scoring.run_curves(pairs, totals, "run", "key", "delta", (0, 1, 5))
    got = {(r["run"], r["tolerance"]): (r["answered"], r["wrong"], r["precision"], r["coverage"]) for r in curves.collect()}
    assert got["r", 0] == (1, 0, 1.0, 0.5) and got["r", 1] == (2, 0, 1.0, 1.0) and got["r", 5] == (2, 1, 0.5, 1.0)
    assert got["none", 5] == (0, 0, None, 0.0) and got["q", 5] == (1, 0, 1.0, 1.0)
    limits = {r["run"]: (r["first_loss"], r["first_coverage_move"]) for r in scoring.curve_limits(curves, "run").collect()}
    assert limits == {"r": (5, 1), "q": (None, None), "none": (None, None)}
    some = scoring.curve_grid(curves.where("run <> 'none'"))
    assert tuple(scoring.exact_through(some).first()) == (1, 5)
    assert tuple(scoring.exact_through(scoring.curve_grid(curves)).first()) == (None, 5)


def test_members_are_rows(spark):
    items = spark.createDataFrame([("g", "A", "x", "o2", 5), ("g", "A", "y", "o1", None)], "group_key string, code string, reason string, order_id string, amount_paise long")
    assert tuple(exceptions.groups(items).first()) == ("g", "A", ["x", "y"], 2, 5, "o1")
    assert sorted(map(tuple, exceptions.members(items).collect())) == [("g", "o1"), ("g", "o2")]
