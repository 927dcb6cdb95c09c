"""The reconciliation: tiers over ledgers, each on what the ones before left open, then attribution and exceptions."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.calendar import add_business_days, business_calendar
from ledgerloom.functions.text import narration_similarity
from ledgerloom.operators import attribution as A
from ledgerloom.operators import batches as B
from ledgerloom.operators import exceptions as X
from ledgerloom.operators import matching as M
from ledgerloom.operators.identify import identified as identify
from ledgerloom.operators.membership import memberships
from ledgerloom.sources.checkpoints import cut
from ledgerloom.sources.ledgers import Ledgers


#: The columns that some tier reads; no other is written to files.
READ = {
    "orders": ("order_id", "event_date", "amount_paise", "ord"), "payments": ("payment_id", "order_id", "settlement_id", "ts", "event_date", "method", "amount_paise", "fee_paise", "tax_paise", "ord"),
    "refunds": ("item_id", "payment_id", "settlement_id", "event_date", "amount_paise"), "chargebacks": ("item_id", "payment_id", "settlement_id", "event_date", "amount_paise"),
    "settlements": ("settlement_id", "event_date", "utr", "net_paise", "gross_paise", "fee_paise", "tax_paise", "refund_paise", "chargeback_paise", "withholding_paise", "carry_forward_in_paise", "carry_forward_out_paise", "ord"),
    "bank": ("bank_row_id", "event_date", "narration", "utr", "credit_paise", "debit_paise", "entry_type", "ord"),
}


@dataclass(frozen=True)
class Reconciliation:
    """decisions(order_id, outcome, payment_id, settlement_id, bank_row_id, tier, confidence, reason), settlements and their rows,
    declines of all tiers, verdicts of the batches, attributions, credits that a strong cause ties to a payout,
    memberships of credits that no payout explains, exception groups
    and their orders, what became of bank rows, and the batches as rebuilt."""

    decisions: DataFrame
    tied: DataFrame
    declines: DataFrame
    verdicts: DataFrame
    attributions: DataFrame
    identified: DataFrame
    memberships: DataFrame
    groups: DataFrame
    members: DataFrame
    dispositions: DataFrame
    batches: DataFrame


def with_likeness(credits: DataFrame) -> DataFrame:
    """``credits`` with likeness, how much each narration is a payout's; each narration and reference is compared once."""
    texts = credits.select("narration", "utr").distinct()
    told = cut(texts.withColumn("likeness", narration_similarity(F.col("narration"), F.coalesce("utr", F.lit("AAAA000000000000")))))
    told = told.withColumnsRenamed({"narration": "__n", "utr": "__u"})
    return credits.join(told, F.col("narration").eqNullSafe(F.col("__n")) & F.col("utr").eqNullSafe(F.col("__u"))).drop("__n", "__u")


def reconcile(ledgers: Ledgers, rates: C.Rates | None = None, as_of: Column | None = None, tiers: tuple[int, ...] = (1, 2, 3, 5), strict: bool = True, part_b: bool = True, windows: tuple[int, int, int] = (C.EXACT_WINDOW, C.TOLERANT_WINDOW, C.NET_WINDOW)) -> Reconciliation:
    """Every tier's narrow result is cut to files: several later ones read it, and none repeats what made it.

    ``windows``: business days in which a payout is posted, for the exact, the tolerant and the net tier.
    """
    rates = rates or C.Rates()
    spark = ledgers.orders.sparkSession
    ledgers = Ledgers(*[cut(getattr(ledgers, f.name).select(*[c for c in READ[f.name] if c in getattr(ledgers, f.name).columns])) for f in fields(Ledgers)])
    span = ledgers.settlements.agg(F.min("event_date").alias("a"), F.max("event_date").alias("b")).unionByName(ledgers.bank.agg(F.min("event_date").alias("a"), F.max("event_date").alias("b"))).agg(F.min("a"), F.max("b")).first()
    first, last = span[0], span[1]
    if first is None:
        raise ValueError("neither a settlement nor a bank row has a date")
    cal = business_calendar(spark, first - timedelta(days=30), last + timedelta(days=60), rates.holidays)
    credits = ledgers.bank.where("entry_type = 'bank_credit'")
    due = lambda df, n: add_business_days(df, cal, "event_date", n, "hi")
    gates = cut(M.order_gates(ledgers.orders, ledgers.payments, ledgers.chargebacks))

    def order_side(tier: int, rows: DataFrame, settled: DataFrame, missing: str) -> DataFrame:
        """Orders of a tier with their settlement's verdict (settlement_id, bank_row_id, reason, confidence) and the tier's own reason."""
        j = rows.join(settled.select("settlement_id", "bank_row_id", F.col("reason").alias("upstream"), "confidence"), "settlement_id", "left")
        return j.withColumn("reason", F.coalesce("gate", F.when(F.col("bank_row_id").isNull(), F.coalesce("upstream", F.lit(missing))))).withColumn("tier", F.lit(tier))

    def decisions(j: DataFrame) -> DataFrame:
        return j.where("reason is null").select("order_id", F.lit("MATCHED").alias("outcome"), "payment_id", "settlement_id", "bank_row_id", "tier", "confidence", F.lit(None).cast("string").alias("reason"))

    def declines(tier: int, j: DataFrame, settled: DataFrame, caused: Column) -> list[DataFrame]:
        o = j.where("reason is not null").select("tier", F.col("order_id").alias("entity_id"), F.lit("orders").alias("kind"), "reason", caused.alias("caused_by"))
        s = settled.where("bank_row_id is null").select(F.lit(tier).alias("tier"), F.col("settlement_id").alias("entity_id"), F.lit("settlements").alias("kind"), "reason", F.lit(None).cast("string").alias("caused_by"))
        return [o, s]

    # tier 1
    exact = cut(M.exact_settlements(due(ledgers.settlements, windows[0]), credits).withColumn("confidence", F.lit(1.0)))
    t1 = order_side(1, gates, exact, "SETTLEMENT_ID_NOT_FOUND")
    t1 = cut(t1.withColumn("reason", F.when(F.col("gate").isNull() & F.col("settlement_id").isNull(), "PAYMENT_HAS_NO_SETTLEMENT_ID").otherwise(F.col("reason"))))
    caused = F.when(F.col("gate").isNull() & F.col("upstream").isNotNull(), F.col("settlement_id")).cast("string")
    parts = [decisions(t1)]
    told = [*declines(1, t1, exact, caused), M.credit_declines(credits, exact, ledgers.settlements).select(F.lit(1).alias("tier"), F.col("bank_row_id").alias("entity_id"), F.lit("bank").alias("kind"), "reason", F.lit(None).cast("string").alias("caused_by"))]
    tied = exact.where("bank_row_id is not null").select("settlement_id", "bank_row_id", F.lit(1).alias("tier"))
    open_orders = t1.where("reason is not null").select(*gates.columns)

    counts = ledgers.payments.where("settlement_id is not null").groupBy("settlement_id").agg(F.count("*").alias("n_payments"))
    left_s = ledgers.settlements.join(tied, "settlement_id", "left_anti")
    left_c = credits.join(tied, "bank_row_id", "left_anti")
    if 2 in tiers:
        s2 = due(left_s.join(counts, "settlement_id", "left").fillna(0, ["n_payments"]), windows[1])
        tol = cut(M.tolerant_settlements(left_s, cut(M.tolerant_pairs(s2, left_c))))
        t2 = cut(order_side(2, open_orders, tol, "NO_TOLERANT_CANDIDATE"))
        parts.append(decisions(t2))
        told += declines(2, t2, tol, F.when(F.col("gate").isNull(), F.col("settlement_id")).cast("string"))
        tied = cut(tied.unionByName(tol.where("bank_row_id is not null").select("settlement_id", "bank_row_id", F.lit(2).alias("tier"))))
    verdicts = spark.createDataFrame([], "settlement_id string, expected_net_paise long, outcome string, bank_row_id string, variance_paise long, confidence double, identified_by string")
    gaps_schema = "gap_id string, settlement_id string, delta long, level string, outcome string, item_id string, n_candidates long, expected double, band string, confidence double"
    attributed = spark.createDataFrame([], gaps_schema)
    named = spark.createDataFrame([], "settlement_id string, bank_row_id string, delta long, level string, item_id string, expected double")
    inferred = spark.createDataFrame([], "bank_row_id string, credit_paise long, outcome string, pool_size long, n_solutions long, solutions array<array<string>>, expected double, band string, confidence double")
    built = spark.createDataFrame([], "settlement_id string, expected_net_paise long")
    if 3 in tiers:
        built = cut(B.build_batches(ledgers.settlements, ledgers.payments, ledgers.refunds, ledgers.chargebacks, rates))
        if strict:
            B.assert_self_check(built)
        open_b = due(built.join(tied, "settlement_id", "left_anti"), windows[2])
        free = ledgers.bank.join(tied, "bank_row_id", "left_anti")
        free_c = cut(free.where("entry_type = 'bank_credit'"))
        items = cut(A.item_pool(ledgers.payments, ledgers.refunds, ledgers.chargebacks, rates.withholding_bps))
        utr_pairs = cut(M.unique_by_utr(open_b, free_c))
        zero_pairs = M.zero_payouts(open_b.where("expected_net_paise = 0"), free)
        # credits that one strong cause ties to an open batch without a reference of its own
        nameless = cut(open_b.where("expected_net_paise > 0").join(utr_pairs, "settlement_id", "left_anti").select("settlement_id", "expected_net_paise", "event_date", "hi"))
        named = identified = cut(identify(nameless, free_c, items))
        limit = as_of if as_of is not None else F.lit(ledgers.bank.agg(F.max("event_date")).first()[0])
        verdicts = cut(M.net_settlements(open_b, free_c.unionByName(free.where("credit_paise = 0 and debit_paise = 0")), utr_pairs, zero_pairs, identified, limit))
        settled = verdicts.select("settlement_id", F.when(F.col("outcome") == "MATCHED", F.col("bank_row_id")).alias("bank_row_id"), F.col("outcome").alias("reason"), "confidence")
        done = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        t3 = cut(open_orders.join(done.select("order_id"), "order_id", "left_anti").join(settled.select("settlement_id", "bank_row_id", F.col("reason").alias("upstream"), "confidence"), "settlement_id", "left"))
        t3m = t3.where("gate is null and bank_row_id is not null").withColumn("tier", F.lit(3))
        parts.append(t3m.select("order_id", F.lit("MATCHED").alias("outcome"), "payment_id", "settlement_id", "bank_row_id", "tier", "confidence", F.lit(None).cast("string").alias("reason")))
        tied = cut(tied.unionByName(verdicts.where("outcome = 'MATCHED' and bank_row_id is not null").select("settlement_id", "bank_row_id", F.lit(3).alias("tier"))))
        # what explains the payouts that are tied or carry a reference, yet differ
        still = ledgers.settlements.join(tied, "settlement_id", "left_anti")
        explain = tied.select("settlement_id", "bank_row_id").unionByName(M.unique_by_utr(still, credits.join(tied, "bank_row_id", "left_anti")))
        both = explain.join(built.select("settlement_id", "expected_net_paise"), "settlement_id").join(ledgers.bank.select("bank_row_id", "credit_paise"), "bank_row_id")
        delta = both.select(F.concat_ws("/", "settlement_id", "bank_row_id").alias("gap_id"), "settlement_id", (F.col("expected_net_paise") - F.col("credit_paise")).alias("delta")).where("delta <> 0")
        attributed = cut(A.attribute(cut(delta), items))
        claimed = explain.select("bank_row_id")
        if part_b:
            loose = credits.join(claimed, "bank_row_id", "left_anti")
            inferred = memberships(with_likeness(loose), ledgers.payments, cal, rates, F.col("likeness"))
        cause = attributed.where("level = 'L3' and outcome = 'ATTRIBUTED'").select("settlement_id").unionByName(identified.where("level = 'L3'").join(verdicts.where("identified_by = 'attribution'").select("settlement_id", "bank_row_id"), ["settlement_id", "bank_row_id"], "left_semi").select("settlement_id")).distinct()
        t3x = t3.where("gate is null and bank_row_id is null and upstream is not null").join(cause.withColumn("refined", F.lit(True)), "settlement_id", "left")
        code = F.when((F.col("upstream") == "AMOUNT_VARIANCE_UNEXPLAINED") & F.col("refined"), "CHARGEBACK_UNPOSTED").otherwise(F.col("upstream"))
        shown = verdicts.select("settlement_id", F.col("bank_row_id").alias("shown"))
        parts.append(t3x.join(shown, "settlement_id", "left").select("order_id", code.alias("outcome"), F.lit(None).cast(gates.schema["payment_id"].dataType).alias("payment_id"), "settlement_id", F.col("shown").alias("bank_row_id"), F.lit(3).alias("tier"), F.lit(0.0).alias("confidence"), F.lit("batch_outcome").alias("reason")))
        told += [t3.where("gate is not null").select(F.lit(3).alias("tier"), F.col("order_id").alias("entity_id"), F.lit("orders").alias("kind"), F.col("gate").alias("reason"), F.lit(None).cast("string").alias("caused_by")), settled.where("bank_row_id is null").select(F.lit(3).alias("tier"), F.col("settlement_id").alias("entity_id"), F.lit("settlements").alias("kind"), "reason", F.lit(None).cast("string").alias("caused_by"))]
    everything = told[0]
    for x in told[1:]:
        everything = everything.unionByName(x)
    everything = cut(everything)
    decided = parts[0]
    for x in parts[1:]:
        decided = decided.unionByName(x)
    decided = cut(decided)
    grouped = spark.createDataFrame([], "group_key string, code string, reasons array<string>, chain_count long, total_paise long, first_order string")
    members = spark.createDataFrame([], "group_key string, order_id string")
    if 5 in tiers:
        undecided = ledgers.orders.join(decided.select("order_id"), "order_id", "left_anti").select("order_id", "amount_paise")
        items5 = cut(X.typed(undecided, X.merge_declines(everything.where("kind = 'orders'"))))
        grouped, members = X.groups(items5), X.members(items5)
        null = lambda c: F.lit(None).cast(decided.schema[c].dataType).alias(c)
        decided = decided.unionByName(items5.select("order_id", F.col("code").alias("outcome"), null("payment_id"), null("settlement_id"), null("bank_row_id"), F.lit(5).alias("tier"), F.lit(0.0).alias("confidence"), "reason"))
    matched = tied.select("bank_row_id", F.lit("MATCHED").alias("m"))
    disposed = ledgers.bank.join(matched, "bank_row_id", "left").select("bank_row_id", F.coalesce("m", F.when(F.col("entry_type") == "bank_debit", "IGNORED")).alias("disposition")).where("disposition is not null")
    return Reconciliation(decided, tied, everything, verdicts, attributed, named, inferred, grouped, members, disposed, built)
