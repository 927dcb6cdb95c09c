"""Views over ledgers and a reconciliation: pages, chains, traces, one entity, one finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.ledgers import Ledgers


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit in order; a page has 1 to 200 rows."""
    return df.orderBy(order).offset(max(0, offset)).limit(min(200, max(1, limit)))


def chains(l: Ledgers) -> DataFrame:
    """order, payment, settlement and bank row of each order's chain; what is missing is null."""
    p = l.payments.select("order_id", "payment_id", "settlement_id")
    s = l.settlements.select("settlement_id", "utr")
    b = l.bank.where("entry_type = 'bank_credit' and utr is not null").select("utr", "bank_row_id")
    return l.orders.select("order_id").join(p, "order_id", "left").join(s, "settlement_id", "left").join(b, "utr", "left")


def links_by_narration(l: Ledgers) -> DataFrame:
    """(settlement_id, bank_row_id) wherever a narration holds a settlement's reference as a part of it.

    References of sixteen characters are looked up by equality over the narration's own stretches of that length.
    """
    b = l.bank.select("bank_row_id", F.upper("narration").alias("n")).where(F.length("n") >= 16)
    parts = b.select("bank_row_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("n") - 15), lambda i: F.substring(F.col("n"), i, F.lit(16))))).alias("utr"))
    return l.settlements.where("utr is not null").select("settlement_id", "utr").join(parts, "utr").select("settlement_id", "bank_row_id")


def payout_rows(l: Ledgers) -> DataFrame:
    """(settlement_id, source, entry_id, amount_paise) of everything inside each payout: its payments, their orders once, its reversals."""
    p = l.payments.where("settlement_id is not null")
    own = p.select("settlement_id", "order_id").distinct().join(l.orders.select("order_id", "amount_paise"), "order_id")
    out = own.select("settlement_id", F.lit("orders").alias("source"), F.col("order_id").alias("entry_id"), "amount_paise")
    parts = [(p, "payments", "payment_id"), (l.refunds, "refunds", "item_id"), (l.chargebacks, "chargebacks", "item_id")]
    for df, source, key in parts:
        out = out.unionByName(df.where("settlement_id is not null").select("settlement_id", F.lit(source).alias("source"), F.col(key).alias("entry_id"), "amount_paise"))
    return out


def run_summary(decisions: DataFrame) -> DataFrame:
    """One row: orders, matched, exceptions and the share matched."""
    return decisions.agg(F.count("*").alias("orders"), F.count_if(F.col("outcome") == "MATCHED").alias("matched"), F.count_if(F.col("outcome") != "MATCHED").alias("exceptions"), F.try_divide(F.count_if(F.col("outcome") == "MATCHED"), F.count("*")).alias("coverage"))
