"""Exceptions typed from declines, their groups, the queue, and the cash position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom import config as C


def merge_declines(declines: DataFrame) -> DataFrame:
    """(entity_id, kind, reason, caused_by): of several tiers' declines (tier, entity_id, ...) the latest tier's."""
    last = declines.groupBy("entity_id").agg(F.max_by(F.struct("kind", "reason", "caused_by"), "tier").alias("d"))
    return last.select("entity_id", "d.kind", "d.reason", "d.caused_by")


def typed(orders: DataFrame, declines: DataFrame) -> DataFrame:
    """Undecided orders (order_id, amount_paise) with reason, code, caused_by and group_key."""
    d = declines.select(F.col("entity_id").alias("order_id"), "reason", "caused_by")
    rows = orders.join(d, "order_id", "left").withColumn("reason", F.coalesce("reason", F.lit("NOT_DECLINED_BY_ANY_TIER")))
    code = F.lit("UNKNOWN")
    for reason, name in C.REASON_TO_CODE.items():
        code = F.when(F.col("reason") == reason, name).otherwise(code)
    rows = rows.withColumn("code", code)
    return rows.withColumn("group_key", F.coalesce(F.col("caused_by").cast("string"), F.col("code")))


def groups(items: DataFrame) -> DataFrame:
    """(group_key, code, reasons, chain_count, total_paise, first_order) of typed exceptions; ``members`` has their orders."""
    return items.groupBy("group_key").agg(
        F.min("code").alias("code"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.count("*").alias("chain_count"),
        F.sum("amount_paise").alias("total_paise"), F.min("order_id").alias("first_order"),
    )


def members(items: DataFrame) -> DataFrame:
    """(group_key, order_id), a row for each: a group may hold a third of all orders, too many for one row."""
    return items.select("group_key", "order_id")


def breakdown(items: DataFrame, dims: list[str], amount: str) -> DataFrame:
    """Counts, money and share of money by each of ``dims`` alone, in one pass: (dimension, value, findings, paise, share)."""
    parts = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]))
    out = items.select(parts.alias("p"), F.col(amount).alias("__a")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("findings"), F.sum("__a").alias("paise"))
    return out.withColumn("share", F.try_divide(F.col("paise"), F.sum("paise").over(W.partitionBy("dimension"))))


def cash_rows(settlements: DataFrame, findings: DataFrame) -> DataFrame:
    """settlements (settlement_id, net_paise) with bucket and at_stake_paise; findings: (settlement_id, code, paise)."""
    rows = settlements.join(findings, "settlement_id", "left")
    bucket = F.when(F.col("code").isNull(), "confirmed").when(F.col("code") == "MISSING_IN_BANK", "at_risk").when(F.col("code") == "TIMING_PENDING", "expected").otherwise("disputed")
    rows = rows.withColumn("bucket", bucket)
    stake = F.when(F.col("bucket") == "confirmed", 0).when(F.col("bucket").isin("at_risk", "expected"), F.col("net_paise")).otherwise(F.col("paise"))
    return rows.withColumn("at_stake_paise", stake.cast("long"))


def cash_position(rows: DataFrame) -> DataFrame:
    """(bucket, payouts, paise), every bucket once: confirmed payouts count with their net, others with what is at stake."""
    spark = rows.sparkSession
    all_ = spark.createDataFrame([(b,) for b in C.CASH_BUCKETS], "bucket string")
    paise = F.when(F.col("bucket") == "confirmed", F.col("net_paise")).otherwise(F.col("at_stake_paise"))
    own = rows.groupBy("bucket").agg(F.count("*").alias("payouts"), F.sum(paise).alias("paise"))
    return all_.join(own, "bucket", "left").fillna(0, ["payouts", "paise"])


def decline_rollup(declines: DataFrame) -> DataFrame:
    """(kind, reason, n, root_causes) of declines by kind, by reason, by both and in all; null where summed over."""
    d = declines.select("kind", "reason", F.col("caused_by").isNull().alias("root"))
    return d.groupingSets([["kind", "reason"], ["kind"], ["reason"], []], "kind", "reason").agg(F.count("*").alias("n"), F.count_if("root").alias("root_causes"))


def first_codes(chains: DataFrame) -> DataFrame:
    """(settlement_id, chains, first_code) from (settlement_id, code, ord): the code of the earliest chain that has one."""
    rows = chains.where("settlement_id is not null").groupBy("settlement_id")
    return rows.agg(F.count("*").alias("chains"), F.min_by("code", F.when(F.col("code").isNotNull(), F.col("ord"))).alias("first_code"))
