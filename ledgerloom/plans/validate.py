"""Checks of six ledgers against their own rules, by section, and the summary of each section."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.calendar import add_business_days, capture_day
from ledgerloom.functions.money import apply_bps
from ledgerloom.operators.batches import with_fees
from ledgerloom.operators.ranking import numbered
from ledgerloom.operators.scoring import checks
from ledgerloom.sources.checkpoints import cut
from ledgerloom.sources.ledgers import Ledgers

KEYS = {"orders": "order_id", "payments": "payment_id", "refunds": "item_id", "chargebacks": "item_id", "settlements": "settlement_id", "bank": "bank_row_id"}
#: Table, column, and the table it must point into.
REFERENCES = (
    ("payments", "order_id", "orders"), ("refunds", "payment_id", "payments"), ("chargebacks", "payment_id", "payments"),
    ("payments", "settlement_id", "settlements"), ("refunds", "settlement_id", "settlements"), ("chargebacks", "settlement_id", "settlements"),
)


def ledger_checks(l: Ledgers, rates: C.Rates | None = None) -> DataFrame:
    """(section, check, passed, failures): every rule over all rows; a rule without rows passes.

    A null reference points nowhere and breaks no reference rule; payments without a payout have a rule of their own.
    Each rule is counted where its rows lie; only keys and sums by payout are shuffled.
    """
    rates = rates or C.Rates()

    def failing(section: str, check: str, rows: DataFrame) -> DataFrame:
        n = F.count("*")
        return rows.agg((n == 0).alias("passed"), n.alias("failures")).select(F.lit(section).alias("section"), F.lit(check).alias("check"), "passed", "failures")

    parts = [failing("identity", f"{t}_unique", getattr(l, t).groupBy(k).agg(F.count("*").alias("n")).where("n > 1")) for t, k in KEYS.items()]
    for t, column, parent in REFERENCES:
        have = getattr(l, parent).select(F.col(KEYS[parent]).alias(column))
        parts.append(failing("references", f"{t}_{column}", getattr(l, t).where(F.col(column).isNotNull()).select(column).join(have, column, "left_anti")))
    disputed = l.chargebacks.select("payment_id")
    parts.append(failing("references", "refunded_and_disputed", l.refunds.select("payment_id").distinct().join(disputed, "payment_id", "left_semi")))

    c = F.col
    own = with_fees(l.payments, rates)
    parts.append(checks(own, "payments", {"batched": c("settlement_id").isNotNull(), "amount_not_negative": c("amount_paise") >= 0, "fee_of_method": c("fee_paise") == c("own_fee"), "tax_of_fee": c("tax_paise") == c("own_tax")}))

    total = lambda df, **sums: df.where("settlement_id is not null").groupBy("settlement_id").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    s = l.settlements.join(total(l.payments, g="amount_paise", f="fee_paise", t="tax_paise"), "settlement_id", "left")
    s = s.join(total(l.refunds, r="amount_paise"), "settlement_id", "left").join(total(l.chargebacks, k="amount_paise"), "settlement_id", "left").fillna(0, ["g", "f", "t", "r", "k"])
    equation = c("gross_paise") - c("fee_paise") - c("tax_paise") - c("refund_paise") - c("chargeback_paise") - c("withholding_paise") - c("carry_forward_in_paise") + c("carry_forward_out_paise")
    parts.append(checks(s, "cycles", {
        "gross_of_members": c("gross_paise") == c("g"), "fee_of_members": c("fee_paise") == c("f"), "tax_of_members": c("tax_paise") == c("t"), "refunds_of_cycle": c("refund_paise") == c("r"),
        "chargebacks_of_cycle": c("chargeback_paise") == c("k"), "withholding": c("withholding_paise") == apply_bps(c("gross_paise"), rates.withholding_bps), "equation": c("net_paise") == equation,
        "net_not_negative": c("net_paise") >= 0, "below_gross": c("net_paise") <= c("gross_paise"), "carried_out_pays_nothing": (c("carry_forward_out_paise") == 0) | (c("net_paise") == 0),
        "settled_on_business_day": (F.weekday("event_date") < 5) & ~c("event_date").isin(list(rates.holidays)) if rates.holidays else F.weekday("event_date") < 5,
    }))
    captured = l.payments.select("payment_id", c("event_date").alias("captured"))
    for t in ("refunds", "chargebacks"):
        parts.append(checks(getattr(l, t).select("payment_id", "event_date").join(captured, "payment_id"), "dates", {f"{t}_after_capture": c("event_date") >= c("captured")}))
    parts.append(checks(l.bank, "bank", {"one_sided": (c("credit_paise") == 0) | (c("debit_paise") == 0), "not_negative": (c("credit_paise") >= 0) & (c("debit_paise") >= 0)}))
    return reduce(DataFrame.unionByName, parts)


def neighbours(df: DataFrame, order: list, columns: list[str]) -> DataFrame:
    """``columns`` of each row and, as before_*, of the row before it in ``order``; the first row isn't among them.

    Rows are numbered across a sort by range and joined to their successors, so that no task holds the whole order.
    """
    rows, _ = numbered(df.select(*columns, *[c.alias(f"__o{k}") for k, c in enumerate(order)]), [F.col(f"__o{k}") for k in range(len(order))], "__n")
    rows = cut(rows.select("__n", *columns))
    return rows.join(rows.select((F.col("__n") + 1).alias("__n"), *[F.col(c).alias(f"before_{c}") for c in columns]), "__n").drop("__n")


def sequence_checks(l: Ledgers, calendar: DataFrame, rates: C.Rates | None = None) -> DataFrame:
    """(section, check, passed, failures) of the rules about days and order: when cycles settle and what they carry on, which captures
    and reversals they take in, and how the statement runs. The balance is checked where the bank has one (balance_paise).

    A cycle without a due day in the calendar breaks its rule; a payment or reversal of no known cycle breaks none here.
    """
    rates = rates or C.Rates()
    c = F.col
    s = add_business_days(l.settlements.select("settlement_id", "capture_date", "event_date", "gross_paise", "net_paise", "carry_forward_in_paise", "carry_forward_out_paise"), calendar, "capture_date", rates.lag_days, "due")
    business = calendar.where("is_business").select(c("day").alias("event_date"), F.lit(True).alias("open"))
    s = s.join(F.broadcast(business), "event_date", "left")
    parts = [checks(s, "cycles", {"settles_when_due": c("event_date") == c("due"), "settles_on_a_business_day": c("open").isNotNull()})]
    links = neighbours(l.settlements, [c("capture_date"), c("ord"), c("settlement_id")], ["carry_forward_in_paise", "carry_forward_out_paise"])
    parts.append(checks(links, "cycles", {"carry_goes_on": c("carry_forward_in_paise") == c("before_carry_forward_out_paise")}))
    first = l.settlements.orderBy("capture_date", "ord", "settlement_id").limit(1)
    parts.append(checks(first, "cycles", {"first_carries_nothing_in": c("carry_forward_in_paise") == 0}))
    own = l.payments.select("settlement_id", "method", "fee_paise", capture_day(c("ts"), rates.cutoff_hour).alias("captured"))
    free = [m for m, bps in rates.mdr_bps.items() if bps == 0]
    parts.append(checks(own, "payments", {"method_has_a_rate": c("method").isin(list(rates.mdr_bps)), "free_method_is_free": ~c("method").isin(free) | (c("fee_paise") == 0)}))
    taken = own.join(l.settlements.select("settlement_id", "capture_date"), "settlement_id")
    parts.append(checks(taken, "payments", {"in_its_days_cycle": c("captured") == c("capture_date")}))
    # the first cycle on or after each day, by day: as many rows as the calendar has days
    days = l.settlements.select(c("event_date").alias("cycle")).where("cycle is not null").distinct()
    marks = calendar.select(c("day")).join(F.broadcast(days), c("day") == c("cycle"), "left")
    nexts = marks.withColumn("next", F.first("cycle", ignorenulls=True).over(W.orderBy("day").rowsBetween(0, W.unboundedFollowing))).select(c("day").alias("__day"), "next")
    for t in ("refunds", "chargebacks"):
        r = getattr(l, t).select("settlement_id", c("event_date").alias("__day")).join(l.settlements.select("settlement_id", "event_date"), "settlement_id").join(F.broadcast(nexts), "__day", "left")
        parts.append(checks(r, "dates", {f"{t}_in_the_next_cycle": c("event_date") == c("next")}))
    columns = ["event_date", "credit_paise", "debit_paise", *(["balance_paise"] if "balance_paise" in l.bank.columns else [])]
    rows = neighbours(l.bank, [c("ord")], columns)
    rules = {"in_order_of_days": c("event_date") >= c("before_event_date")}
    if "balance_paise" in l.bank.columns:
        rules["balance_runs_on"] = c("balance_paise") == c("before_balance_paise") + c("credit_paise") - c("debit_paise")
    parts.append(checks(rows, "bank", rules))
    return reduce(DataFrame.unionByName, parts)


def summary(checked: DataFrame) -> DataFrame:
    """(section, checks, passed, failures) of ``checked``."""
    return checked.groupBy("section").agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), F.sum("failures").alias("failures"))
