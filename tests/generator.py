"""Synthetic ledgers with known defects: every draw is a hash of the row's own key, so partitions don't change it.

Orders become captures, reversals and settlement cycles; the bank statement is what the cycles paid, with defects.
Orders are dealt to days evenly; a cycle is a capture day, so cycles and bank rows number as the days, not the orders.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.config import Rates
from ledgerloom.functions.calendar import add_business_days, business_calendar, capture_day
from ledgerloom.functions.money import apply_bps, format_rupees
from ledgerloom.functions.text import extract_utr
from ledgerloom.operators.batches import carry_forward, running_balance, with_fees
from ledgerloom.sources.checkpoints import cut
from ledgerloom.sources.ledgers import FILES, Ledgers, entry_type

#: Defect rates (fixed values).
DEFECTS = {
    "order_never_paid": 0.040, "order_amount_typo": 0.010, "duplicate_capture": 0.030, "partial_refund": 0.080, "full_refund": 0.025,
    "chargeback": 0.012, "narration_truncated": 0.300, "settlement_late_posting": 0.050, "settlement_missing_in_bank": 0.020,
    "direct_bank_credit": 0.020, "rounding_drift": 0.015, "refund_wrong_cycle": 0.080, "chargeback_silent_deduction": 0.040,
    "payment_missing_from_report": 0.060, "chargeback_wrong_cycle": 0.080, "compound_shortfall": 0.080,
}
#: What a cycle's credit lacks, in the order in which a cycle is tried; a cycle has one of them at most.
SHORT_BY = ("refund_wrong_cycle", "chargeback_silent_deduction", "payment_missing_from_report", "chargeback_wrong_cycle", "compound_shortfall")
CLIP, OPENING = 35, 500_000_000


@dataclass(frozen=True)
class Generated:
    """ledgers, truth(order_id, expected, defects) and cycles(settlement_id, defects, short_paise, bank_row_id)."""

    ledgers: Ledgers
    truth: DataFrame
    cycles: DataFrame


def uniform(seed: int, tag: str, *key: str) -> Column:
    """A number in [0, 1) that depends on the seed, the tag and the row's key only."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), *[F.col(k) for k in key]), F.lit(1 << 30)) / float(1 << 30)


def between(u: Column, low: int, high: int) -> Column:
    return (F.floor(u * (high - low + 1)) + low).cast("long")


def generate(spark: SparkSession, n_orders: int = 1000, start: date = date(2026, 6, 1), days: int = 45, seed: int = 42, rates: Rates | None = None, defects: dict[str, float] | None = None) -> Generated:
    """Ledgers of ``n_orders``; ``defects`` replaces rates by name, and other names are refused."""
    rates = rates or Rates()
    if unknown := set(defects or {}) - set(DEFECTS):
        raise ValueError(f"no such defects: {sorted(unknown)}")
    rate = DEFECTS | (defects or {})
    hit = lambda name, *key: uniform(seed, name, *key) < rate[name]
    calendar = business_calendar(spark, start - timedelta(days=10), start + timedelta(days=days + 120), rates.holidays)

    # orders: most are small, some medium, few large
    n = spark.range(1, n_orders + 1).withColumnRenamed("id", "n")
    size, u = uniform(seed, "size", "n"), uniform(seed, "amount", "n")
    true = F.when(size < 0.7, between(u, 19_900, 199_900)).when(size < 0.95, between(u, 199_900, 999_900)).otherwise(between(u, 999_900, 4_999_900))
    o = n.withColumns({
        "order_id": F.format_string("ord_%06d", "n"), "customer_id": F.format_string("cust_%05d", between(uniform(seed, "customer", "n"), 1, max(1, n_orders // 3))),
        "event_date": F.date_add(F.lit(start), between(uniform(seed, "day", "n"), 0, days - 1).cast("int")), "true": true,
        "unpaid": hit("order_never_paid", "n"), "typo": hit("order_amount_typo", "n"), "twice": hit("duplicate_capture", "n"),
    })
    o = o.withColumns({"typo": F.col("typo") & ~F.col("unpaid"), "twice": F.col("twice") & ~F.col("unpaid")})
    orders = o.select("order_id", "customer_id", "event_date", F.when(F.col("typo"), F.col("true") + between(uniform(seed, "typo", "n"), 1, 99) * 100).otherwise(F.col("true")).alias("amount_paise"), F.lit("placed").alias("status"), F.lit("INR").alias("currency"), F.col("n").alias("ord"))

    # captures, and the cycle of each: its capture day after the cutoff, paid some business days later
    p = o.where("not unpaid").withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    pick = uniform(seed, "method", "n", "copy")
    method = F.when(pick < 0.45, "upi").when(pick < 0.80, "card").when(pick < 0.93, "netbanking").otherwise("wallet")
    second = between(uniform(seed, "second", "n", "copy"), 0, 86_399)
    p = p.withColumn("ts", F.timestamp_add("SECOND", second.cast("int"), F.col("event_date").cast("timestamp_ntz")))
    p = p.withColumns({"payment_id": F.format_string("pay_%06d", F.col("n") * 2 + F.col("copy")), "method": method, "amount_paise": F.col("true"), "capture_date": capture_day(F.col("ts"), rates.cutoff_hour), "ord": F.col("n") * 2 + F.col("copy")})
    p = p.withColumn("settlement_id", F.concat(F.lit("setl_"), F.date_format("capture_date", "yyyyMMdd"), F.lit("_001")))
    p = with_fees(p, rates).withColumnsRenamed({"own_fee": "fee_paise", "own_tax": "tax_paise"})
    payments = cut(p.select("payment_id", "order_id", "settlement_id", "ts", F.to_date("ts").alias("event_date"), "capture_date", "method", "amount_paise", "fee_paise", "tax_paise", F.lit("captured").alias("status"), "ord"))

    # reversals go to the first cycle of their day or after; later than all cycles, to none. At most one kind for each payment
    made = cut(payments.groupBy("settlement_id", "capture_date").agg(F.count("*").alias("n_payments"), F.sum("amount_paise").alias("gross_paise"), F.sum("fee_paise").alias("fee_paise"), F.sum("tax_paise").alias("tax_paise")))
    starts = made.select(F.col("capture_date").alias("at"), "settlement_id")
    w = W.orderBy("day").rowsBetween(0, W.unboundedFollowing)
    following = calendar.select("day").join(starts, F.col("day") == F.col("at"), "left").select("day", F.first("settlement_id", ignorenulls=True).over(w).alias("settlement_id"))
    full, part, back = hit("full_refund", "ord"), hit("partial_refund", "ord"), hit("chargeback", "ord")
    kind = F.when(full, "full").when(part, "part").when(back, "chargeback")
    r = payments.select("payment_id", "order_id", "ord", "event_date", "amount_paise").withColumn("kind", kind).where("kind is not null")
    share = between(uniform(seed, "share", "ord"), 10, 80)
    r = r.withColumns({"amount_paise": F.when(F.col("kind") == "part", F.floor(F.col("amount_paise") * share / 100).cast("long")).otherwise(F.col("amount_paise")), "event_date": F.date_add("event_date", between(uniform(seed, "wait", "ord"), 1, 20).cast("int"))})
    r = cut(r.join(F.broadcast(following.withColumnRenamed("day", "event_date")), "event_date", "left"))
    item = lambda prefix: F.format_string(f"{prefix}_%06d", "ord").alias("item_id")
    columns = ("payment_id", "settlement_id", "event_date", "amount_paise", "ord")
    refunds, chargebacks = r.where("kind <> 'chargeback'").select(item("rfnd"), *columns), r.where("kind = 'chargeback'").select(item("cb"), *columns)

    # cycles: a row for each capture day
    total = lambda df, out: df.where("settlement_id is not null").groupBy("settlement_id").agg(F.sum("amount_paise").alias(out))
    s = made.join(total(refunds, "refund_paise"), "settlement_id", "left").join(total(chargebacks, "chargeback_paise"), "settlement_id", "left").fillna(0, ["refund_paise", "chargeback_paise"])
    s = s.withColumn("withholding_paise", apply_bps(F.col("gross_paise"), rates.withholding_bps)).withColumn("one", F.lit(1))
    raw = F.col("gross_paise") - F.col("fee_paise") - F.col("tax_paise") - F.col("withholding_paise") - F.col("refund_paise") - F.col("chargeback_paise")
    s = carry_forward(s.withColumn("raw", raw), ["one"], ["capture_date"], "raw").withColumnsRenamed({"carry_in": "carry_forward_in_paise", "carry_out": "carry_forward_out_paise", "payout": "net_paise"})
    s = add_business_days(s, calendar, "capture_date", rates.lag_days, "event_date")
    digits = F.lpad(F.pmod(F.xxhash64(F.lit(seed), F.lit("utr"), "settlement_id"), F.lit(10**12)).cast("string"), 12, "0")
    settlements = cut(s.withColumns({"utr": F.concat(F.lit("CHIE"), digits), "ord": F.unix_date("capture_date").cast("long")}).drop("one", "raw", "n_payments"))

    # the statement
    key = "settlement_id"
    c = settlements.select(key, "event_date", "utr", "net_paise", "ord")
    donors = r.select(key, F.when(F.col("kind") == "chargeback", "chargeback").otherwise("refund").alias("what"), "amount_paise", "ord").unionByName(payments.select(key, F.lit("payment").alias("what"), "amount_paise", "ord"))
    draw = F.struct(uniform(seed, "donor", "ord"), F.col("amount_paise"))
    least = lambda what: F.min(F.when(F.col("what") == what, draw)).getField("amount_paise").alias(what)
    one = donors.where(f"{key} is not null").groupBy(key).agg(least("refund"), least("chargeback"), least("payment"))
    c = c.join(one, key, "left")
    amounts = (F.col("refund"), F.col("chargeback"), F.col("payment"), F.col("chargeback"), F.col("refund") + F.col("chargeback"))
    short, why = F.lit(None).cast("long"), F.lit(None).cast("string")
    for name, amount in reversed(list(zip(SHORT_BY, amounts, strict=True))):
        here = hit(name, key) & amount.isNotNull() & (amount < F.col("net_paise"))
        short, why = F.when(here, amount).otherwise(short), F.when(here, name).otherwise(why)
    paid = F.col("net_paise") > 0
    c = c.withColumns({"short_by": why, "short_paise": F.coalesce(short, F.lit(0)), "missing": hit("settlement_missing_in_bank", key) & paid, "late": hit("settlement_late_posting", key), "clipped": hit("narration_truncated", key), "drift": hit("rounding_drift", key) & paid})
    c = c.withColumn("drift_paise", F.when(F.col("drift"), F.when(uniform(seed, "drift", key) < 0.5, -1).otherwise(1)).otherwise(0).cast("long"))
    c = add_business_days(c, calendar, "event_date", F.when(F.col("late"), between(uniform(seed, "late", key), 4, 6)).otherwise(between(uniform(seed, "post", key), 0, 2)).cast("long"), "posted")
    names = [F.when(F.col(k), F.lit(v)) for k, v in (("missing", "settlement_missing_in_bank"), ("late", "settlement_late_posting"), ("clipped", "narration_truncated"), ("drift", "rounding_drift"))]
    row = F.concat(F.lit("bank_"), F.lpad(F.col("ord").cast("string"), 6, "0"))
    c = cut(c.withColumns({"defects": F.array_compact(F.array(*names, F.col("short_by"))), "bank_row_id": F.when(~F.col("missing") & paid, row)}))
    text = F.concat(F.lit("NEFT CR-RATN0000088-PAYOUT SERVICE PVT LTD-MERCHANT-"), "utr")
    credits = c.where("bank_row_id is not null").select("bank_row_id", F.col("posted").alias("event_date"), F.when(F.col("clipped"), F.substring(text, 1, CLIP)).otherwise(text).alias("narration"), (F.col("net_paise") - F.col("short_paise") + F.col("drift_paise")).alias("credit_paise"), F.lit(0).cast("long").alias("debit_paise"), "ord")
    # other rows: direct credits, and one charge or fee on every fourth day
    other = settlements.select(key, "event_date", F.col("ord").alias("o"))
    direct = other.where(hit("direct_bank_credit", key)).select(F.format_string("bank_d%06d", "o").alias("bank_row_id"), "event_date", F.format_string("NEFT CR-DIRECT CUSTOMER %d", "o").alias("narration"), between(uniform(seed, "direct", key), 50_000, 900_000).alias("credit_paise"), F.lit(0).cast("long").alias("debit_paise"), (F.col("o") + 10**6).alias("ord"))
    charge = other.where(uniform(seed, "charge", key) < 0.25).select(F.format_string("bank_c%06d", "o").alias("bank_row_id"), "event_date", F.lit("BANK CHARGES").alias("narration"), F.lit(0).cast("long").alias("credit_paise"), between(uniform(seed, "fee", key), 100, 5_000).alias("debit_paise"), (F.col("o") + 2 * 10**6).alias("ord"))
    bank = credits.unionByName(direct).unionByName(charge).withColumn("one", F.lit(1))
    bank = running_balance(bank, ["one"], ["event_date", "bank_row_id"], OPENING).withColumnRenamed("running_paise", "balance_paise").drop("one")
    bank = bank.withColumns({"utr": extract_utr(F.col("narration")), "entry_type": entry_type(F.col("credit_paise"))})

    # the truth of an order: the first of its own defects, then of its cycle's
    own = payments.groupBy("order_id").agg(F.min("settlement_id").alias(key))
    hits = r.where("kind = 'chargeback'").select("order_id", F.lit(True).alias("back")).distinct()
    reversed_ = r.where("kind <> 'chargeback'").groupBy("order_id").agg(F.max(F.when(F.col("kind") == "full", "full_refund").otherwise("partial_refund")).alias("refunded"))
    t = o.select("order_id", "unpaid", "typo", "twice").join(own, "order_id", "left").join(hits, "order_id", "left").join(reversed_, "order_id", "left")
    t = t.join(F.broadcast(c.select(key, "missing", "short_by")), key, "left")
    expected = F.when(F.col("unpaid"), "ORDER_UNPAID").when(F.col("twice"), "DUPLICATE_PAYMENT").when(F.col("missing"), "MISSING_IN_BANK").when(F.col("back"), "CHARGEBACK_UNPOSTED").when(F.col("typo") | F.col("short_by").isNotNull(), "AMOUNT_VARIANCE_UNEXPLAINED").otherwise("MATCHED")
    flags = [F.when(F.col(k), F.lit(v)) for k, v in (("unpaid", "order_never_paid"), ("typo", "order_amount_typo"), ("twice", "duplicate_capture"), ("back", "chargeback"), ("missing", "settlement_missing_in_bank"))]
    truth = t.select("order_id", expected.alias("expected"), F.array_compact(F.array(*flags, F.col("refunded"), F.col("short_by"))).alias("defects"))
    return Generated(Ledgers(orders, payments, refunds, chargebacks, settlements, bank), truth, c.select(key, "defects", "short_paise", "bank_row_id"))


def to_text(ledgers: Ledgers, name: str) -> DataFrame:
    """A ledger in the columns of its CSV file, all text, none as the empty text."""
    df = getattr(ledgers, name)
    given = {"refund_id": "item_id", "chargeback_id": "item_id", "order_date": "event_date", "created_at": "event_date", "captured_at": "ts", "settled_on": "event_date", "txn_date": "event_date", "tax_on_fee": "tax_paise", "refunds": "refund_paise", "chargebacks": "chargeback_paise"}
    out = []
    for column in FILES[name][1]:
        source = given.get(column, column)
        if source not in df.columns:
            source = f"{column}_paise"
        value = format_rupees(F.col(source)) if source.endswith("_paise") else F.date_format(source, "yyyy-MM-dd'T'HH:mm:ss") if source == "ts" else F.col(source).cast("string")
        out.append(F.coalesce(value, F.lit("")).alias(column))
    return df.select(*out)
