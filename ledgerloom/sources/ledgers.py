"""Ledger files as DataFrames: six CSV files, every column read as text, and their canonical rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.money import parse_paise
from ledgerloom.functions.text import extract_utr

#: File names and columns, in order (fixed values).
FILES = {
    "orders": ("orders.csv", ("order_id", "customer_id", "order_date", "amount", "status", "currency")),
    "payments": ("gateway_payments.csv", ("payment_id", "order_id", "captured_at", "amount", "method", "fee", "tax_on_fee", "status", "settlement_id")),
    "refunds": ("gateway_refunds.csv", ("refund_id", "payment_id", "amount", "created_at", "settlement_id")),
    "chargebacks": ("gateway_chargebacks.csv", ("chargeback_id", "payment_id", "amount", "created_at", "settlement_id")),
    "settlements": ("gateway_settlements.csv", ("settlement_id", "capture_date", "settled_on", "utr", "gross", "fee", "tax", "refunds", "chargebacks", "withholding", "carry_forward_in", "carry_forward_out", "net")),
    "bank": ("bank.csv", ("bank_row_id", "txn_date", "narration", "credit", "debit", "balance")),
}


@dataclass(frozen=True)
class Ledgers:
    """orders(order_id, event_date, amount_paise), payments(payment_id, order_id, settlement_id, ts, method, amount_paise, fee_paise, tax_paise),
    refunds and chargebacks(item_id, payment_id, settlement_id, event_date, amount_paise), settlements(settlement_id, capture_date, event_date, utr, *_paise),
    bank(bank_row_id, event_date, narration, utr, credit_paise, debit_paise, balance_paise, entry_type); each with ord, the order in its file."""

    orders: DataFrame
    payments: DataFrame
    refunds: DataFrame
    chargebacks: DataFrame
    settlements: DataFrame
    bank: DataFrame

    def entries(self) -> DataFrame:
        """All rows in one shape: (entry_id, source, entry_type, event_date, amount_paise, signed_paise)."""
        parts = []
        for source, df, id_, kind, amount, sign in (
            ("orders", self.orders, "order_id", F.lit("order"), F.col("amount_paise"), 1),
            ("payments", self.payments, "payment_id", F.lit("payment"), F.col("amount_paise"), 1),
            ("refunds", self.refunds, "item_id", F.lit("refund"), F.col("amount_paise"), -1),
            ("chargebacks", self.chargebacks, "item_id", F.lit("chargeback"), F.col("amount_paise"), -1),
            ("settlements", self.settlements, "settlement_id", F.lit("settlement"), F.col("net_paise"), 1),
            ("bank", self.bank, "bank_row_id", F.col("entry_type"), F.col("credit_paise") - F.col("debit_paise"), 1),
        ):
            parts.append(df.select(F.col(id_).cast("string").alias("entry_id"), F.lit(source).alias("source"), kind.alias("entry_type"), "event_date", amount.alias("amount_paise"), (amount * sign).alias("signed_paise")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def counts(self) -> DataFrame:
        return self.entries().groupBy("source").agg(F.count("*").alias("n"))


def read_text_csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the six files, all columns text, with ord; other names are refused."""
    if name not in FILES:
        raise ValueError(f"{name!r} is not a ledger; one of {sorted(FILES)} is")
    file, columns = FILES[name]
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{file}")
    return rows.withColumn("ord", F.monotonically_increasing_id())


def ref(c: str) -> Column:
    """A reference: the empty text is none."""
    return F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)


def day(c: str) -> Column:
    return F.to_date(F.substring(F.col(c), 1, 10), "yyyy-MM-dd")


def entry_type(credit: Column) -> Column:
    return F.when(credit > 0, "bank_credit").otherwise("bank_debit")


def normalise(raw: DataFrame, name: str) -> DataFrame:
    money = lambda c, out=None: parse_paise(F.col(c)).alias(f"{out or c}_paise")
    if name == "orders":
        return raw.select(ref("order_id"), ref("customer_id"), day("order_date").alias("event_date"), money("amount"), "status", "currency", "ord")
    if name == "payments":
        return raw.select(ref("payment_id"), ref("order_id"), ref("settlement_id"), F.to_timestamp_ntz("captured_at").alias("ts"), day("captured_at").alias("event_date"), "method", money("amount"), money("fee"), money("tax_on_fee", "tax"), "ord")
    if name in ("refunds", "chargebacks"):
        key = "refund_id" if name == "refunds" else "chargeback_id"
        return raw.select(F.col(key).alias("item_id"), ref("payment_id"), ref("settlement_id"), day("created_at").alias("event_date"), money("amount"), "ord")
    if name == "settlements":
        same = [money(c) for c in ("gross", "fee", "tax", "withholding", "carry_forward_in", "carry_forward_out", "net")]
        return raw.select(ref("settlement_id"), day("capture_date").alias("capture_date"), day("settled_on").alias("event_date"), ref("utr"), *same, money("refunds", "refund"), money("chargebacks", "chargeback"), "ord")
    credit = parse_paise(F.col("credit"))
    narration = F.coalesce("narration", F.lit(""))
    return raw.select(ref("bank_row_id"), day("txn_date").alias("event_date"), narration.alias("narration"), extract_utr(narration).alias("utr"), credit.alias("credit_paise"), money("debit"), money("balance"), entry_type(credit).alias("entry_type"), "ord")


def load(spark: SparkSession, folder: str) -> Ledgers:
    return Ledgers(**{name: normalise(read_text_csv(spark, folder, name), name) for name in FILES})


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.option("header", True).option("lineSep", "\n").option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)
