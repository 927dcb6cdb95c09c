"""Settlement cycles rebuilt from their payments, and the order checks over ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.config import Rates
from ledgerloom.functions.money import apply_bps


def mdr(method: Column, rates: Rates) -> Column:
    out = F.lit(None).cast("int")
    for name, bps in rates.mdr_bps.items():
        out = F.when(method == name, bps).otherwise(out)
    return out


def with_fees(payments: DataFrame, rates: Rates) -> DataFrame:
    """Adds own_fee and own_tax, recomputed from the method's rate."""
    fee = apply_bps(F.col("amount_paise"), mdr(F.col("method"), rates))
    return payments.withColumn("own_fee", fee).withColumn("own_tax", apply_bps(F.col("own_fee"), rates.tax_on_fee_bps))


def net_contribution(amount: Column, fee: Column, tax: Column, withholding_bps: int) -> Column:
    return amount - fee - tax - apply_bps(amount, withholding_bps)


def build_batches(settlements: DataFrame, payments: DataFrame, refunds: DataFrame, chargebacks: DataFrame, rates: Rates) -> DataFrame:
    """One row for each settlement: recomputed terms, expected net and carry; withholding is taken once on the gross."""
    p = with_fees(payments.where("settlement_id is not null"), rates).groupBy("settlement_id").agg(
        F.count("*").alias("n_payments"), F.sum("amount_paise").alias("own_gross"), F.sum("own_fee").alias("own_fee"), F.sum("own_tax").alias("own_tax")
    )
    total = lambda df, out: df.where("settlement_id is not null").groupBy("settlement_id").agg(F.sum("amount_paise").alias(out))
    rows = settlements.join(p, "settlement_id", "left").join(total(refunds, "own_refund"), "settlement_id", "left").join(total(chargebacks, "own_chargeback"), "settlement_id", "left")
    rows = rows.fillna(0, ["n_payments", "own_gross", "own_fee", "own_tax", "own_refund", "own_chargeback"])
    rows = rows.withColumn("own_withholding", apply_bps(F.col("own_gross"), rates.withholding_bps))
    raw = F.col("own_gross") - F.col("own_fee") - F.col("own_tax") - F.col("own_withholding") - F.col("own_refund") - F.col("own_chargeback") - F.col("carry_forward_in_paise")
    rows = rows.withColumn("raw_paise", raw)
    return rows.withColumns({"expected_net_paise": F.greatest("raw_paise", F.lit(0)), "own_carry_out": F.greatest(-F.col("raw_paise"), F.lit(0))})


class SelfCheckFailure(AssertionError):
    """A settlement report disagrees with its own payments."""


def self_check(batches: DataFrame) -> DataFrame:
    """One row: how many batches there are, and how many equal the report in every term."""
    pairs = (("own_gross", "gross_paise"), ("own_fee", "fee_paise"), ("own_tax", "tax_paise"), ("own_withholding", "withholding_paise"), ("own_refund", "refund_paise"), ("own_chargeback", "chargeback_paise"), ("own_carry_out", "carry_forward_out_paise"), ("expected_net_paise", "net_paise"))
    ok = F.lit(True)
    for a, b in pairs:
        ok = ok & F.col(a).eqNullSafe(F.col(b))
    return batches.agg(F.count("*").alias("total"), F.count_if(ok).alias("exact"))


def assert_self_check(batches: DataFrame) -> None:
    r = self_check(batches).first()
    if r["total"] != r["exact"]:
        raise SelfCheckFailure(f"{r['total'] - r['exact']} of {r['total']} settlements disagree with their payments")


def carry_forward(cycles: DataFrame, partition: list[str], order: list[str], raw: str) -> DataFrame:
    """carry_in, carry_out and payout of a chain of cycles that never pay below zero.

    c_t = max(0, c_(t-1) - raw_t) in closed form: the running sum S of -raw less the least S so far (at most 0).
    """
    w = W.partitionBy(*partition).orderBy(*order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    rows = cycles.withColumn("__s", F.sum(-F.col(raw)).over(run))
    rows = rows.withColumn("carry_out", F.col("__s") - F.least(F.lit(0), F.min("__s").over(run)))
    rows = rows.withColumn("carry_in", F.lag("carry_out", 1, 0).over(w))
    return rows.withColumn("payout", F.greatest(F.lit(0), F.col(raw) - F.col("carry_in"))).drop("__s")


def running_balance(bank: DataFrame, partition: list[str], order: list[str], opening: int) -> DataFrame:
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return bank.withColumn("running_paise", F.sum(F.col("credit_paise") - F.col("debit_paise")).over(w) + opening)


def next_cycle(items: DataFrame, cycles: DataFrame, key: str, item_id: str, day: str, cycle_day: str, cycle_id: str) -> DataFrame:
    """As-of join forward: each item's first cycle of its key on or after its day, ties to the smaller id; null if none.

    Items and cycles are sorted together within the key, and the next cycle is looked up behind each item: no pairs
    are made, whatever the number of cycles.
    """
    tagged = items.select(F.col(key), F.col(day).alias("__d"), F.lit(0).alias("__t"), F.col(item_id).alias("__i"), F.lit(None).cast(cycles.schema[cycle_id].dataType).alias("__c"))
    marks = cycles.select(F.col(key), F.col(cycle_day).alias("__d"), F.lit(1).alias("__t"), F.lit(None).cast(items.schema[item_id].dataType).alias("__i"), F.col(cycle_id).alias("__c"))
    w = W.partitionBy(key).orderBy("__d", "__t", "__c").rowsBetween(0, W.unboundedFollowing)
    both = tagged.unionByName(marks).withColumn("__n", F.first("__c", ignorenulls=True).over(w))
    return both.where("__t = 0").select(F.col("__i").alias(item_id), F.col("__n").alias(cycle_id))
