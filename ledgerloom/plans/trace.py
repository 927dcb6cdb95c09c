"""Why not: each entity's declines, tier by tier, in sentences about its own row, and what became of it in the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import format_inr
from ledgerloom.plans.queue import facts
from ledgerloom.sources.ledgers import Ledgers

#: One sentence for each reason; {utr}, {net}, {amount} and {narration} are the row's own.
SENTENCES = {
    "NARRATION_HAS_NO_UTR": "Nothing in {narration} can be read as a reference.",
    "UTR_NOT_IN_SETTLEMENT_REPORT": "Its reference {utr} belongs to no reported payout.",
    "SETTLEMENT_NOT_MATCHED_TO_BANK": "The payout it names was not matched, so this row isn't either.",
    "BANK_ROW_ALREADY_CLAIMED": "The row that fits already pays another payout.",
    "NO_BANK_CREDIT_WITH_UTR": "No credit carries the reference {utr}.",
    "AMOUNT_MISMATCH": "A credit carries its reference, but not the net of {net}.",
    "OUTSIDE_POSTING_WINDOW": "The credit that fits was posted outside the window.",
    "AMBIGUOUS_MULTI_CANDIDATE": "Several candidates fit equally well.",
    "NO_TOLERANT_CANDIDATE": "No credit comes near its net of {net} in the wider window.",
    "BANK_ROW_CONTESTED": "Another payout fits the same credit as well.",
    "AMOUNT_VARIANCE_UNEXPLAINED": "A credit was found, but no item accounts for what it differs by.",
    "MISSING_IN_BANK": "Its net is right by its own rows, yet no credit shows it.",
    "TIMING_PENDING": "Its credit may still come before the window closes.",
    "NO_PAYMENT_FOR_ORDER": "No payment names this order.",
    "MULTIPLE_PAYMENTS_FOR_ORDER": "More than one payment names this order.",
    "PAYMENT_HAS_CHARGEBACK": "Its payment is disputed.",
    "PAYMENT_HAS_NO_SETTLEMENT_ID": "Its payment names no payout.",
    "SETTLEMENT_ID_NOT_FOUND": "The payout its payment names is not reported.",
    "ORDER_PAYMENT_AMOUNT_MISMATCH": "Its payment is not of {amount}.",
}
OTHER = "Declined for {reason}, of which nothing is written down."
IGNORED = "Money that leaves the account can't be a payout."


def own_rows(l: Ledgers) -> DataFrame:
    """(entity_id, source, event_date, amount_paise, net_paise, utr, narration) of every row that a tier can decline."""
    none = F.lit(None)
    one = lambda df, id_, source, amount, net, utr, text: df.select(F.col(id_).cast("string").alias("entity_id"), F.lit(source).alias("source"), "event_date", amount.cast("long").alias("amount_paise"), net.cast("long").alias("net_paise"), utr.cast("string").alias("utr"), text.cast("string").alias("narration"))
    a, n, u = F.col("amount_paise"), F.col("net_paise"), F.col("utr")
    parts = one(l.orders, "order_id", "orders", a, a, none, none).unionByName(one(l.payments, "payment_id", "payments", a, a, none, none))
    parts = parts.unionByName(one(l.settlements, "settlement_id", "settlements", n, n, u, none))
    credit = F.col("credit_paise") - F.col("debit_paise")
    return parts.unionByName(one(l.bank, "bank_row_id", "bank", credit, credit, u, F.col("narration")))


def sentence(reason: Column) -> Column:
    """The sentence of a reason about the row beside it; a reason without one says so, and no slot is left empty."""
    text = F.replace(F.lit(OTHER), F.lit("{reason}"), F.coalesce(reason, F.lit("no stated reason")))
    for k, v in SENTENCES.items():
        text = F.when(reason == k, v).otherwise(text)
    quoted = F.when(F.trim(F.coalesce("narration", F.lit(""))) == "", "a row without narration").otherwise(F.concat(F.lit('"'), F.trim("narration"), F.lit('"')))
    slots = {"{narration}": quoted, "{utr}": F.coalesce("utr", F.lit("none recorded")), "{net}": format_inr(F.coalesce("net_paise", F.lit(0))), "{amount}": format_inr(F.coalesce("amount_paise", F.lit(0)))}
    for slot, value in slots.items():
        text = F.replace(text, F.lit(slot), value)
    return text


def outcomes(l: Ledgers, decisions: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(entity_id, source, state, code, tier, note) of every entity: an order's decision, else a bank row's disposition, else the
    decision of a payout's first order; state is matched, exception, ignored or undecided."""
    rows = own_rows(l).select("entity_id", "source")
    own = decisions.select(F.col("order_id").cast("string").alias("entity_id"), F.lit("orders").alias("source"), F.col("outcome").alias("code"), "tier")
    paid = decisions.where("settlement_id is not null").groupBy(F.col("settlement_id").cast("string").alias("entity_id")).agg(F.min_by(F.struct("outcome", "tier"), F.struct("tier", "order_id")).alias("d"))
    own = own.unionByName(paid.select("entity_id", F.lit("settlements").alias("source"), F.col("d.outcome").alias("code"), F.col("d.tier").alias("tier")))
    own = own.unionByName(dispositions.where("disposition in ('MATCHED', 'IGNORED')").select(F.col("bank_row_id").cast("string").alias("entity_id"), F.lit("bank").alias("source"), F.col("disposition").alias("code"), F.lit(None).cast("int").alias("tier")))
    rows = rows.join(own, ["entity_id", "source"], "left")
    state = F.when(F.col("code").isNull(), "undecided").when(F.col("code") == "MATCHED", "matched").when(F.col("code") == "IGNORED", "ignored").otherwise("exception")
    return rows.select("entity_id", "source", state.alias("state"), "code", "tier", F.when(F.col("code") == "IGNORED", IGNORED).alias("note"))


def traces(l: Ledgers, declines: DataFrame, decisions: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(entity_id, source, state, code, tier, note, steps) of every entity; steps: tier, reason, sentence, caused_by, by tier."""
    told = declines.select("tier", F.col("entity_id").cast("string").alias("entity_id"), F.col("kind").alias("source"), "reason", "caused_by").join(own_rows(l), ["entity_id", "source"])
    step = F.struct(F.col("tier").cast("int").alias("tier"), "reason", sentence(F.col("reason")).alias("sentence"), "caused_by")
    steps = told.groupBy("entity_id", "source").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # one for each tier
    out = outcomes(l, decisions, dispositions).join(steps, ["entity_id", "source"], "left")
    return out.withColumn("steps", F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)))


def entity_facts(l: Ledgers) -> DataFrame:
    """(entity_id, source, label, value): what each entity's own row says, a row for each fact that isn't null."""
    rows = own_rows(l).withColumn("key", F.struct("entity_id", "source"))
    told = facts(rows, "key", {"date": F.col("event_date"), "amount": format_inr(F.col("amount_paise")), "utr": F.col("utr"), "narration": F.nullif(F.col("narration"), F.lit(""))})
    return told.select("key.entity_id", "key.source", "label", "value")
