"""The review queue over the whole reconciliation: payouts and kinds of orders, with cause and exposure, and each finding in detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.money import format_inr
from ledgerloom.operators import attribution as A
from ledgerloom.operators.ranking import numbered
from ledgerloom.plans import queue
from ledgerloom.plans.reconcile import Reconciliation
from ledgerloom.sources.ledgers import Ledgers

#: Verdicts of a payout that are findings, and the words of headlines (fixed values).
OPEN = ("MISSING_IN_BANK", "AMOUNT_VARIANCE_UNEXPLAINED", "AMBIGUOUS_MULTI_CANDIDATE", "TIMING_PENDING")
ABSENT = {"MISSING_IN_BANK": "payout never arrived", "TIMING_PENDING": "still inside the clearing window"}
CAUSES = {"chargeback": "chargeback {item} not recorded in books", "refund": "refund {item} from an earlier cycle", "payment": "payment {item} booked to another cycle"}
SEVERAL, NOTHING = "{n} possible causes, needs gateway breakdown", "cause not identified"
WORDS = {2: "two", 3: "three", 4: "four", 5: "five", 6: "six"}
ORDERS = {
    "ORDER_UNPAID": "Orders with no payment anywhere", "DUPLICATE_PAYMENT": "Orders captured more than once",
    "AMOUNT_VARIANCE_UNEXPLAINED": "Orders whose value disagrees with the capture", "CHARGEBACK_UNPOSTED": "Disputes debited but not recorded",
}
#: What to do about each kind of finding; every other kind is looked at by hand.
ACTIONS = {
    "ORDER_UNPAID": "Look the orders up at the checkout and cancel those that were never paid.",
    "DUPLICATE_PAYMENT": "Keep one capture of each order, refund the other and rebuild its payout.",
    "AMOUNT_VARIANCE_UNEXPLAINED": "Hold each order's value against its capture and put the wrong one right.",
    "CHARGEBACK_UNPOSTED": "Post the disputes and tie each debit to the payout it was taken from.",
    "MISSING_IN_BANK": "Ask the gateway whether the payout was sent, and look at later statements.",
    "TIMING_PENDING": "Wait for the window to close, then run again.",
    "AMBIGUOUS_MULTI_CANDIDATE": "Ask the gateway which payout each credit belongs to.",
}
BY_HAND = "Look at these by hand; no rule covers them."
KINDS = {"L1": "payment", "L2": "refund", "L3": "chargeback", "L4": "pair"}


def _pick(key: Column, values: dict, other: Column) -> Column:
    for k, v in values.items():
        other = F.when(key == k, v).otherwise(other)
    return other


def payout_headline(code: Column, day: Column, kind: Column, item: Column, n: Column) -> Column:
    """Day and cause: that it never came, what accounts for the gap, how many things might, or that nothing does."""
    cause = F.lit(NOTHING)
    cause = F.when(n > 1, F.replace(F.lit(SEVERAL), F.lit("{n}"), _pick(n, WORDS, n.cast("string")))).otherwise(cause)
    for k, text in CAUSES.items():
        cause = F.when((kind == k) & item.isNotNull(), F.replace(F.lit(text), F.lit("{item}"), item)).otherwise(cause)
    return F.concat(queue.day_text(day), F.lit(" – "), _pick(code, ABSENT, cause))


def order_headline(code: Column) -> Column:
    return _pick(code, ORDERS, queue.headline(code))


def exposure(code: Column, expected: Column, variance: Column) -> Column:
    """A payout that never came risks all of it, one that came short the gap, every other its whole net."""
    whole = F.coalesce(expected, F.lit(0))
    return F.when(code == "MISSING_IN_BANK", whole).when(F.coalesce(variance, F.lit(0)) != 0, F.abs(variance)).otherwise(whole)


def payout_findings(verdicts: DataFrame, settlements: DataFrame, decisions: DataFrame, attributions: DataFrame, identified: DataFrame) -> DataFrame:
    """A row for each payout with an open verdict; the code is that of its orders, which a named cause may have refined."""
    own = decisions.where("outcome <> 'MATCHED' and settlement_id is not null").groupBy("settlement_id").agg(F.count("*").alias("affected_chains"), F.min("outcome").alias("of_orders"))
    told = attributions.select("settlement_id", "level", "outcome", "item_id", F.col("n_candidates").alias("n"), "band", "expected", F.col("gap_id"))
    told = told.withColumn("item_id", F.when(F.col("outcome") == "ATTRIBUTED", F.col("item_id"))).drop("outcome")
    by_cause = identified.join(verdicts.where("identified_by = 'attribution'").select("settlement_id", "bank_row_id"), ["settlement_id", "bank_row_id"])
    also = by_cause.join(told.select("settlement_id"), "settlement_id", "left_anti").select("settlement_id", "level", "item_id", F.lit(1).cast("long").alias("n"), F.lit("STRONG").alias("band"), "expected", F.concat_ws("/", "settlement_id", "bank_row_id").alias("gap_id"))
    v = verdicts.where(F.col("outcome").isin(*OPEN)).join(own, "settlement_id", "left").join(told.unionByName(also), "settlement_id", "left")
    v = v.join(settlements.select("settlement_id", F.col("event_date").alias("settled_on")), "settlement_id", "left")
    code = F.coalesce("of_orders", "outcome")
    kind = _pick(F.col("level"), KINDS, F.lit(None).cast("string"))
    return v.select(
        F.concat_ws("__", code, "settlement_id").alias("group_id"), F.lit("settlement").alias("kind"), code.alias("code"), "settlement_id",
        payout_headline(code, F.col("settled_on"), kind, F.col("item_id"), F.coalesce("n", F.lit(0))).alias("headline"), "settled_on",
        exposure(code, F.col("expected_net_paise"), F.col("variance_paise")).cast("long").alias("rupees_paise"), F.coalesce("affected_chains", F.lit(0)).alias("affected_chains"),
        _pick(code, ACTIONS, F.lit(BY_HAND)).alias("suggested_action"), F.col("band").alias("evidence_band"), "identified_by", "level", "item_id", F.col("expected").alias("expected_fits"), "gap_id",
    )


def order_findings(groups: DataFrame) -> DataFrame:
    """A row for each code of orders that no payout accounts for (code, chain_count, total_paise)."""
    g = groups.groupBy("code").agg(F.sum("chain_count").alias("affected_chains"), F.sum("total_paise").alias("rupees_paise"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    return g.select(
        F.concat(F.lit("tier5__"), "code").alias("group_id"), F.lit("orders").alias("kind"), "code", none("settlement_id", "string"), order_headline(F.col("code")).alias("headline"), none("settled_on", "date"),
        F.col("rupees_paise").cast("long").alias("rupees_paise"), F.col("affected_chains").cast("long").alias("affected_chains"), _pick(F.col("code"), ACTIONS, F.lit(BY_HAND)).alias("suggested_action"),
        *[none(c, "string") for c in ("evidence_band", "identified_by", "level", "item_id")], none("expected_fits", "double"), none("gap_id", "string"),
    )


def review_queue(r: Reconciliation, ledgers: Ledgers) -> DataFrame:
    """All findings, dearest first, with their place and money in words; the numbers come from a sort by range."""
    rows = payout_findings(r.verdicts, ledgers.settlements, r.decisions, r.attributions, r.identified).unionByName(order_findings(r.groups))
    placed, _ = numbered(rows, [F.desc("rupees_paise"), F.asc("group_id")], "place")
    return placed.withColumn("rupees", format_inr(F.col("rupees_paise")))


def findings(r: Reconciliation, ledgers: Ledgers, withholding_bps: int) -> DataFrame:
    """The queue with each finding's detail nested: terms of its payout's equation, evidence, source records, candidates, shape.

    Candidates are the first six of a gap. A finding over orders names none of them: they are in ``r.members``, however many.
    """
    q = review_queue(r, ledgers)
    terms = queue.arithmetic(r.batches).groupBy("settlement_id").agg(F.array_sort(F.collect_list(F.struct("place", "label", "paise"))).alias("t"))  # seven rows at most
    terms = terms.select("settlement_id", F.transform("t", lambda t: F.struct(t["label"].alias("label"), t["paise"].alias("paise"))).alias("terms"))
    v = r.verdicts.select("settlement_id", "expected_net_paise", "bank_row_id", "variance_paise")
    bank = ledgers.bank.select("bank_row_id", F.col("event_date").alias("posted"), "credit_paise", F.substring("narration", 1, 52).alias("narration"))
    s = ledgers.settlements.select("settlement_id", "net_paise", "utr")
    base = q.join(v, "settlement_id", "left").join(terms, "settlement_id", "left").join(bank, "bank_row_id", "left").join(s, "settlement_id", "left")
    actual = F.when(F.col("bank_row_id").isNotNull(), F.col("credit_paise"))
    arithmetic = F.struct(F.col("terms"), F.col("expected_net_paise").alias("expected_paise"), actual.alias("actual_paise"), (F.col("expected_net_paise") - actual).alias("gap_paise"))
    record = lambda role, id_, day, paise, detail: F.struct(F.lit(role).alias("role"), id_.cast("string").alias("id"), day.cast("date").alias("date"), paise.cast("long").alias("paise"), detail.alias("detail"))
    own = record("settlement", F.col("settlement_id"), F.col("settled_on"), F.col("net_paise"), F.concat(F.lit("utr "), F.coalesce("utr", F.lit("(clipped)"))))
    row = record("bank row", F.col("bank_row_id"), F.col("posted"), F.col("credit_paise"), F.col("narration"))
    parts = q.where("item_id is not null").select("group_id", F.explode(F.split("item_id", r"\+")).alias("part"))
    sources = [(ledgers.payments.withColumn("id", F.col("payment_id")), "payment")] + [(df.withColumn("id", F.col("item_id")), k) for df, k in ((ledgers.refunds, "refund"), (ledgers.chargebacks, "chargeback"))]
    known = None
    for df, kind in sources:
        one = df.select(F.col("id").alias("part"), F.lit(f"attributed {kind}").alias("role"), "event_date", "amount_paise", "settlement_id")
        known = one if known is None else known.unionByName(one)
    booked = F.concat(F.lit("booked to "), F.coalesce("settlement_id", F.lit("(none)")))
    attributed = parts.join(known, "part").select("group_id", F.struct("role", F.col("part").cast("string").alias("id"), F.col("event_date").alias("date"), F.col("amount_paise").alias("paise"), booked.alias("detail")).alias("rec"))
    attributed = attributed.groupBy("group_id").agg(F.array_sort(F.collect_list("rec")).alias("items"))  # one item or two
    gaps = q.where("gap_id is not null").join(v, "settlement_id").join(bank.select("bank_row_id", "credit_paise"), "bank_row_id").select("gap_id", "settlement_id", (F.col("expected_net_paise") - F.col("credit_paise")).alias("delta"))
    pool = A.item_pool(ledgers.payments, ledgers.refunds, ledgers.chargebacks, withholding_bps)
    shown = A.shown_candidates(gaps, pool).drop("level")
    paid = ledgers.payments.where("settlement_id is not null").groupBy("settlement_id").agg(F.countDistinct("order_id").alias("so"), F.count("*").alias("sp"))
    loose = r.decisions.where("outcome <> 'MATCHED' and settlement_id is null").select(F.col("outcome").alias("code"), "order_id")
    of_orders = loose.join(ledgers.payments.select("order_id", "payment_id"), "order_id", "left").groupBy("code").agg(F.countDistinct("order_id").alias("oo"), F.count("payment_id").alias("op"))
    base = base.join(attributed, "group_id", "left").join(shown, "gap_id", "left").join(paid, "settlement_id", "left").join(of_orders.withColumn("kind", F.lit("orders")), ["code", "kind"], "left")
    records = F.concat(F.filter(F.array(own, row), lambda x: x["id"].isNotNull()), F.coalesce("items", F.array().cast(attributed.schema["items"].dataType)))
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    shape = F.struct(long(F.coalesce("so", "oo")).alias("orders"), long(F.coalesce("sp", "op")).alias("payments"), F.col("bank_row_id").isNotNull().cast("long").alias("bank_rows"))
    evidence = F.struct("identified_by", "level", F.col("item_id").alias("attributed_item"), F.col("evidence_band").alias("band"), "expected_fits")
    keep = ["place", "group_id", "kind", "code", "settlement_id", "headline", "settled_on", "rupees_paise", "rupees", "affected_chains", "suggested_action"]
    return base.select(*keep, arithmetic.alias("arithmetic"), evidence.alias("evidence"), records.alias("records"), F.coalesce("candidates", F.array().cast(shown.schema["candidates"].dataType)).alias("candidates"), shape.alias("shape"))


def queue_breakdown(q: DataFrame) -> DataFrame:
    """(dimension, value, findings, paise, share) of the queue by kind, code, band and how payouts were identified, in one pass."""
    from ledgerloom.operators.exceptions import breakdown

    dims = q.withColumns({c: F.coalesce(c, F.lit("none")) for c in ("evidence_band", "identified_by")})
    return breakdown(dims, ["kind", "code", "evidence_band", "identified_by"], "rupees_paise")


def compared(q: DataFrame, group_ids: list[str]) -> DataFrame:
    """The findings named, each with total_with_this_code, how many there are of its code, and share_of_queue; a bounded list of ids."""
    counts = q.groupBy("code").agg(F.count("*").alias("total_with_this_code"))
    whole = q.agg(F.sum("rupees_paise").alias("all_paise"))
    rows = q.where(F.col("group_id").isin(group_ids)).join(counts, "code").join(F.broadcast(whole))
    return rows.withColumn("share_of_queue", F.try_divide("rupees_paise", "all_paise")).drop("all_paise")
