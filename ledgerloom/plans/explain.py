"""Prose for exception groups from one template for each code, and its check against the group's own facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import grounding, text
from ledgerloom.functions.money import format_inr

#: One sentence for each code; {n} orders, {money} in all.
SENTENCES = {
    "ORDER_UNPAID": "{n} orders worth {money} have no captured payment.",
    "DUPLICATE_PAYMENT": "{n} orders worth {money} were captured more than once.",
    "MISSING_IN_BANK": "The payout for {n} orders worth {money} was reported, but no bank credit shows it.",
    "TIMING_PENDING": "The payout for {n} orders worth {money} may still be posted within its window.",
    "CHARGEBACK_UNPOSTED": "A dispute holds {n} orders worth {money}.",
    "AMOUNT_VARIANCE_UNEXPLAINED": "Amounts of {n} orders worth {money} disagree, and no single item explains it.",
    "AMBIGUOUS_MULTI_CANDIDATE": "{n} orders worth {money} fit several bank credits, so none was chosen.",
}
OTHER = "{n} orders worth {money} were left undecided."


def explain(groups: DataFrame) -> DataFrame:
    """``groups`` (group_key, code, chain_count, total_paise) with facts, record_hash and prose; an unknown or null code has a general sentence."""
    template = F.lit(OTHER)
    for code, sentence in SENTENCES.items():
        template = F.when(F.col("code") == code, sentence).otherwise(template)
    n, money = F.coalesce(F.col("chain_count"), F.lit(0)).cast("string"), format_inr(F.coalesce(F.col("total_paise"), F.lit(0)))
    facts = F.map_filter(F.create_map(F.lit("group"), F.col("group_key"), F.lit("code"), F.col("code"), F.lit("orders"), n, F.lit("money"), money), lambda _, v: v.isNotNull())
    rows = groups.withColumn("facts", facts).withColumn("record_hash", F.substring(F.sha2(F.to_json("facts"), 256), 1, 32))
    return rows.withColumn("prose", F.concat(F.replace(F.replace(template, F.lit("{n}"), n), F.lit("{money}"), money), F.coalesce(F.concat(F.lit(" Root cause: "), F.col("group_key"), F.lit(".")), F.lit(""))))


def verified(explained: DataFrame) -> DataFrame:
    """``explained`` with unsupported, the amounts and ids of its prose that the facts don't have, and grounded, whether there are none."""
    evidence = F.concat_ws(" ", F.map_values("facts"))
    rows = explained.withColumn("unsupported", text.unsupported(F.col("prose"), evidence))
    return rows.withColumn("grounded", F.size("unsupported") == 0)


def with_cache(explained: DataFrame, cache: DataFrame) -> DataFrame:
    """Prose from ``cache`` (group_key, record_hash, prose) where the record is still the same, else the template's; ``source`` says which."""
    kept = cache.select("group_key", "record_hash", F.col("prose").alias("__cached")).dropDuplicates(["group_key", "record_hash"])
    rows = explained.join(kept, ["group_key", "record_hash"], "left")
    return rows.withColumn("source", F.when(F.col("__cached").isNotNull(), "cache").otherwise("template")).withColumn("prose", F.coalesce("__cached", "prose")).drop("__cached")


#: Sentences of payouts; {day}, {money} and {item} are the finding's own.
PAYOUTS = {
    "MISSING_IN_BANK": "The payout of {day}, {money}, was reported, and no credit shows it.",
    "TIMING_PENDING": "The payout of {day}, {money}, may still come before its window closes.",
    "AMBIGUOUS_MULTI_CANDIDATE": "Several credits fit the payout of {day}, {money}, so none was chosen.",
}
NAMED, SEVERAL, NOTHING = "The payout of {day} differs by {money}, as {kind} {item} does.", "The payout of {day} differs by {money}, and several items fit that.", "The payout of {day} differs by {money}, and no item accounts for it."
#: Said wherever a cause is named, as an amount that fits is no link that the gateway declares.
CAVEAT = " Only the amounts match, which is not proof."
#: Words of which one must stand where a cause is named (fixed values).
CAVEATS = (
    "not proof", "not proven", "does not prove", "only the amounts match", "amounts match", "not confirmed", "remains unverified", "consistent with", "needs confirming",
    "must be confirmed", "to be confirmed",
)
CHECKED = "ok boolean, blank boolean, asserted array<string>, caveat_missing boolean, unsupported array<string>"


def explain_findings(q: DataFrame) -> DataFrame:
    """The review queue (``findings.payout_findings`` and ``order_findings``) with prose: a sentence for each code, and the caveat where
    a cause is named."""
    from ledgerloom.plans.findings import KINDS, _pick

    money = format_inr(F.coalesce("rupees_paise", F.lit(0)))
    cause = F.when(F.col("item_id").isNotNull(), NAMED).when(F.col("level").isin(*KINDS), SEVERAL).otherwise(NOTHING)
    payout = F.concat(_pick(F.col("code"), PAYOUTS, cause), F.when(F.col("item_id").isNotNull() & ~F.col("code").isin(*PAYOUTS), CAVEAT).otherwise(""))
    text = F.when(F.col("kind") == "settlement", payout).otherwise(_pick(F.col("code"), SENTENCES, F.lit(OTHER)))
    slots = {
        "{day}": F.coalesce(F.date_format("settled_on", "d MMMM yyyy"), F.lit("an unknown day")), "{money}": money, "{n}": F.coalesce("affected_chains", F.lit(0)).cast("string"),
        "{kind}": F.coalesce(_pick(F.col("level"), KINDS, F.lit(None).cast("string")), F.lit("item")), "{item}": F.coalesce("item_id", F.lit("none")),
    }
    for slot, value in slots.items():
        text = F.replace(text, F.lit(slot), value)
    return q.withColumn("prose", text)


def checked_prose(explained: DataFrame) -> DataFrame:
    """``explained`` with check (``CHECKED``): no slot left blank, no cause asserted, a caveat where one is named, and every amount and
    id one of the finding's own. It holds for prose from anywhere, not for the templates' alone."""
    prose = F.coalesce("prose", F.lit(""))
    blank = (F.trim(prose) == "") | prose.rlike(r"  |\s[.,]|₹(?![0-9])|\{[a-z]+\}")
    asserted = grounding.said(prose, grounding.ASSERTED)
    bare = F.col("item_id").isNotNull() & F.coalesce(F.contains(prose, F.col("item_id")), F.lit(False)) & (F.size(grounding.said(prose, CAVEATS)) == 0)
    own = F.concat_ws(" ", format_inr(F.coalesce("rupees_paise", F.lit(0))), "settlement_id", F.replace(F.coalesce("item_id", F.lit("")), F.lit("+"), F.lit(" ")))
    strange = text.unsupported(prose, own)
    ok = ~blank & (F.size(asserted) == 0) & ~bare & (F.size(strange) == 0)
    return explained.withColumn("check", F.struct(ok.alias("ok"), blank.alias("blank"), asserted.alias("asserted"), bare.alias("caveat_missing"), strange.alias("unsupported")))
