"""The review queue: items with headline and exposure, what each needs, the page that holds a row, and orders of display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.operators.ranking import numbered
from ledgerloom.sources.checkpoints import cut

#: What would have to hold for a declined entity to match, by its last reason; {amount} is its own.
NEEDS = {
    "NO_PAYMENT_FOR_ORDER": "a payment of {amount} that names this order",
    "MULTIPLE_PAYMENTS_FOR_ORDER": "only one of its payments to be kept",
    "ORDER_PAYMENT_AMOUNT_MISMATCH": "a payment of exactly {amount}",
    "PAYMENT_HAS_CHARGEBACK": "the dispute to be settled",
    "PAYMENT_HAS_NO_SETTLEMENT_ID": "its payment to name a payout",
    "SETTLEMENT_ID_NOT_FOUND": "the payout it names to be reported",
    "NO_BANK_CREDIT_WITH_UTR": "a credit that carries the payout's reference",
    "AMOUNT_MISMATCH": "a credit of exactly {amount}",
    "OUTSIDE_POSTING_WINDOW": "its credit to be posted in the window",
    "AMBIGUOUS_MULTI_CANDIDATE": "a single credit that fits",
    "BANK_ROW_ALREADY_CLAIMED": "a credit of its own",
    "BANK_ROW_CONTESTED": "no other payout to claim the same credit",
    "NO_TOLERANT_CANDIDATE": "a credit near {amount} in the window",
    "NARRATION_HAS_NO_UTR": "a reference in its narration",
    "UTR_NOT_IN_SETTLEMENT_REPORT": "a reported payout with its reference",
    "MISSING_IN_BANK": "a credit of {amount} in the statement",
    "AMOUNT_VARIANCE_UNEXPLAINED": "an item that accounts for the difference",
    "TIMING_PENDING": "its credit to come before the window closes",
    "SETTLEMENT_NOT_MATCHED_TO_BANK": "the payout it names to be matched",
}
UNSTATED = "nothing that has been written down"


def headline(code: Column) -> Column:
    """A code in words: ``ORDER_UNPAID`` is "Order Unpaid"."""
    return F.initcap(F.lower(F.replace(code, F.lit("_"), F.lit(" "))))


def day_text(day: Column) -> Column:
    """Day and short month, as in "05 Jul"."""
    return F.date_format(day, "dd MMM")


def queue_items(items: DataFrame) -> DataFrame:
    """(place, group_key, code, headline, orders, exposure_paise, since) of typed exceptions (with event_date), dearest first.

    Places come from a sort by range, as a group may be a declined payout, of which there are many.
    """
    own = items.groupBy("group_key").agg(F.min("code").alias("code"), F.count("*").alias("orders"), F.sum("amount_paise").alias("exposure_paise"), F.min("event_date").alias("since"))
    placed, _ = numbered(own, [F.desc("exposure_paise"), F.asc("group_key")], "place")
    return placed.select(F.col("place").cast("int").alias("place"), "group_key", "code", headline(F.col("code")).alias("headline"), "orders", "exposure_paise", day_text(F.col("since")).alias("since"))


def counterfactual(declined: DataFrame, amount: Column) -> DataFrame:
    """``declined`` (reason) with would_need; reasons without a stated need say so."""
    need = F.lit(UNSTATED)
    for reason, text in NEEDS.items():
        need = F.when(F.col("reason") == reason, text).otherwise(need)
    return declined.withColumn("would_need", F.replace(need, F.lit("{amount}"), amount))


def page_with(df: DataFrame, key: str, order: list[str], row_id, limit: int) -> DataFrame:
    """The page of at most ``limit`` rows that holds ``row_id`` a third of the way down, with ``at``, each row's place; empty if it isn't there.

    The place is a count of the rows before it, so that no window sorts the whole table in one task.
    """
    here = df.where(F.col(key) == F.lit(row_id)).select(F.struct(*order).alias("__here"))
    before = df.join(F.broadcast(here), F.struct(*order) < F.col("__here")).count()
    if here.isEmpty():
        return df.withColumn("at", F.lit(0).cast("long")).where("false")
    offset = max(0, before - limit // 3)
    rows = df.orderBy(*order).offset(offset).limit(limit)  # at most ``limit`` rows from here on
    return rows.withColumn("at", F.row_number().over(W.orderBy(*order)) + offset - 1)


def population(items: DataFrame) -> DataFrame:
    """``items`` with population, how many of their code there are."""
    counts = items.groupBy("code").agg(F.count("*").alias("population"))  # a row for each code
    return items.join(F.broadcast(counts), "code")


def facts(df: DataFrame, key: str, labels: dict[str, Column]) -> DataFrame:
    """(key, label, value): one row for each fact that isn't null."""
    each = F.array(*[F.struct(F.lit(k).alias("label"), v.cast("string").alias("value")) for k, v in labels.items()])
    return df.select(key, F.explode(each).alias("f")).select(key, "f.label", "f.value").where("value is not null")


def worst(df: DataFrame, key: str, outcome: str) -> DataFrame:
    """(key, worst): each key's outcome that stands first in C.PRECEDENCE; others come last, the smallest of them first."""
    at = F.array_position(F.array(*map(F.lit, C.PRECEDENCE)), F.col(outcome))
    return df.groupBy(key).agg(F.min(F.struct(F.when(at > 0, at).otherwise(len(C.PRECEDENCE) + 1), F.col(outcome).alias("o"))).getField("o").alias("worst"))


def direction(delta: Column) -> Column:
    """Whether what explains a gap is missing from the payout or too much in it."""
    return F.when(delta > 0, "absent").when(delta < 0, "extra").otherwise("none")


def payout_links(settlements: DataFrame, payments: DataFrame, refunds: DataFrame, chargebacks: DataFrame, credits: DataFrame) -> DataFrame:
    """(settlement_id, payments, orders, refunds, chargebacks, credits): how many rows of each ledger one payout links."""
    own = payments.where("settlement_id is not null").groupBy("settlement_id").agg(F.count("*").alias("payments"), F.countDistinct("order_id").alias("orders"))
    rows = settlements.select("settlement_id", "utr").join(own, "settlement_id", "left")
    for name, df in (("refunds", refunds), ("chargebacks", chargebacks)):
        rows = rows.join(df.where("settlement_id is not null").groupBy("settlement_id").agg(F.count("*").alias(name)), "settlement_id", "left")
    rows = rows.join(credits.where("utr is not null").groupBy("utr").agg(F.count("*").alias("credits")), "utr", "left")
    return rows.fillna(0, ["payments", "orders", "refunds", "chargebacks", "credits"]).drop("utr")


def membership_pools(credits: DataFrame, payments: DataFrame, window: int, tolerance: int) -> DataFrame:
    """(bank_row_id, payment_id, contribution): payments that can be in a credit: due within ``window`` calendar days up to its posting and no larger than it.

    ``payments``: payment_id, due, contribution. Credits are put on each day of their window, so the join is on the day.
    """
    c = credits.select("bank_row_id", "credit_paise", F.explode(F.sequence(F.date_sub("event_date", window), "event_date")).alias("due"))
    return c.join(payments, "due").where(F.col("contribution") <= F.col("credit_paise") + tolerance).select("bank_row_id", "payment_id", "contribution")


def pool_totals(credits: DataFrame, payments: DataFrame, window: int, tolerance: int, width: int = 1 << 16) -> DataFrame:
    """(bank_row_id, pool, paise): how many payments ``membership_pools`` lists for each credit with any, and their contributions' sum.

    Payments are put on each day with credits that they are due for and counted by amount; running counts and sums over a day's sorted
    amounts, within buckets of ``width`` paise by a window and before them from the buckets' totals, give each credit's. No credit meets a payment.
    """
    c = credits.select("bank_row_id", "event_date", (F.col("credit_paise") + tolerance).cast("long").alias("v")).where("event_date is not null and v is not null")
    open_ = c.select("event_date").distinct().select("event_date", F.explode(F.sequence(F.date_sub("event_date", window), "event_date")).alias("due"))  # window + 1 rows for each day at most
    bucket = F.floor(F.col("v") / width).alias("b")
    pool = payments.where("contribution is not null").groupBy("due", F.col("contribution").cast("long").alias("v")).agg(F.count("*").alias("n"))
    pool = cut(pool.join(F.broadcast(open_), "due").groupBy("event_date", "v").agg(F.sum("n").alias("n")).select("event_date", bucket, "v", "n", (F.col("n") * F.col("v")).alias("s")))
    none = F.lit(0).cast("long")
    marks = c.join(F.broadcast(pool.select("event_date").distinct()), "event_date", "left_semi").select("event_date", bucket, "v", none.alias("n"), none.alias("s"), "bank_row_id")
    both = pool.withColumn("bank_row_id", F.lit(None).cast(credits.schema["bank_row_id"].dataType)).withColumn("mark", F.lit(0)).unionByName(marks.withColumn("mark", F.lit(1)))
    run = W.partitionBy("event_date", "b").orderBy("v", "mark").rowsBetween(W.unboundedPreceding, 0)
    inside = both.select("event_date", "b", "bank_row_id", "mark", *[F.sum(x).over(run).alias(x) for x in "ns"]).where("mark = 1")
    totals = pool.groupBy("event_date", "b").agg(*[F.sum(x).alias(x) for x in "ns"])
    asked = marks.select("event_date", "b").distinct().join(totals, ["event_date", "b"], "full").fillna(0, list("ns"))
    before = W.partitionBy("event_date").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    prior = asked.select("event_date", "b", *[F.coalesce(F.sum(x).over(before), none).alias(f"p{x}") for x in "ns"])
    seen = inside.join(prior, ["event_date", "b"])
    return seen.groupBy("bank_row_id").agg(F.sum(F.col("n") + F.col("pn")).alias("pool"), F.sum(F.col("s") + F.col("ps")).alias("paise")).where("pool > 0")


def arithmetic(batches: DataFrame) -> DataFrame:
    """(settlement_id, place, label, paise): the terms of each payout's equation in order; reversals and what is carried in only where they aren't zero."""
    term = lambda label, paise: F.struct(F.lit(label).alias("label"), paise.cast("long").alias("paise"))
    less = lambda c: -F.coalesce(F.col(c), F.lit(0))
    always = F.array(term("payments", F.coalesce(F.col("gross_paise"), F.lit(0))), term("fee", less("fee_paise")), term("tax", less("tax_paise")), term("withholding", less("withholding_paise")))
    some = F.array(term("refunds", less("refund_paise")), term("chargebacks", less("chargeback_paise")), term("carried in", less("carry_forward_in_paise")))
    terms = F.concat(always, F.filter(some, lambda t: t["paise"] != 0))
    return batches.select("settlement_id", F.posexplode(terms).alias("place", "t")).select("settlement_id", "place", "t.label", "t.paise")
