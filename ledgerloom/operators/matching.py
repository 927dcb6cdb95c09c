"""Order gates and the three matching tiers: settlements to bank credits, refusing whatever isn't unique both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom import config as C


def order_gates(orders: DataFrame, payments: DataFrame, chargebacks: DataFrame) -> DataFrame:
    """orders with payment_id, settlement_id of their single payment, n_payments and gate, the first reason that bars them."""
    p = payments.where("order_id is not null").groupBy("order_id").agg(F.count("*").alias("n_payments"), F.min(F.struct("payment_id", "amount_paise", "settlement_id")).alias("p"))
    hit = chargebacks.where("payment_id is not null").select(F.col("payment_id"), F.lit(True).alias("hit")).distinct()
    rows = orders.join(p, "order_id", "left").withColumn("payment_id", F.col("p.payment_id")).join(hit, "payment_id", "left")
    gate = (
        F.when(F.col("n_payments").isNull(), "NO_PAYMENT_FOR_ORDER").when(F.col("n_payments") > 1, "MULTIPLE_PAYMENTS_FOR_ORDER")
        .when(~F.col("p.amount_paise").eqNullSafe(F.col("amount_paise")), "ORDER_PAYMENT_AMOUNT_MISMATCH").when(F.col("hit"), "PAYMENT_HAS_CHARGEBACK")
    )
    single = F.col("n_payments") == 1
    rows = rows.withColumn("gate", gate).withColumn("settlement_id", F.when(single, F.col("p.settlement_id")))
    return rows.withColumn("payment_id", F.when(single, F.col("payment_id"))).fillna(0, ["n_payments"]).drop("p", "hit")


def exact_settlements(settlements: DataFrame, credits: DataFrame) -> DataFrame:
    """(settlement_id, bank_row_id, reason) by reference, amount and window [event_date, hi], in this order of reasons.

    ``settlements`` has hi, the last posting day, and ord; a row that two settlements would take goes to the earlier.
    """
    c = credits.where("utr is not null").select("utr", "bank_row_id", F.col("credit_paise").alias("__c"), F.col("event_date").alias("__d"))
    amount = F.col("__c") == F.col("net_paise")
    timely = amount & F.col("__d").between(F.col("event_date"), F.col("hi"))
    pairs = settlements.join(c, "utr", "left").groupBy("settlement_id").agg(
        F.count("bank_row_id").alias("n"), F.count_if(amount).alias("on_amount"), F.count_if(timely).alias("on_date"),
        F.min(F.when(timely, F.col("bank_row_id"))).alias("bank_row_id"), F.min("ord").alias("ord"),
    )
    reason = (
        F.when(F.col("n") == 0, "NO_BANK_CREDIT_WITH_UTR").when(F.col("on_amount") == 0, "AMOUNT_MISMATCH")
        .when(F.col("on_date") == 0, "OUTSIDE_POSTING_WINDOW").when(F.col("on_date") > 1, "AMBIGUOUS_MULTI_CANDIDATE")
    )
    rows = pairs.withColumn("reason", reason).withColumn("bank_row_id", F.when(F.col("reason").isNull(), F.col("bank_row_id")))
    # settlements without a row each stand alone, so that they don't meet in one window
    claim = F.coalesce(F.col("bank_row_id").cast("string"), F.concat(F.lit("-"), F.col("settlement_id").cast("string")))
    first = F.row_number().over(W.partitionBy(claim).orderBy("ord")) == 1
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & ~first, "BANK_ROW_ALREADY_CLAIMED").otherwise(F.col("reason")))
    return rows.select("settlement_id", F.when(F.col("reason").isNull(), F.col("bank_row_id")).alias("bank_row_id"), "reason")


def credit_declines(credits: DataFrame, tied: DataFrame, settlements: DataFrame) -> DataFrame:
    """(bank_row_id, reason) of the credits that no settlement took."""
    known = settlements.where("utr is not null").select("utr", F.lit(True).alias("known")).distinct()
    rows = credits.join(tied.where("bank_row_id is not null").select("bank_row_id"), "bank_row_id", "left_anti").join(known, "utr", "left")
    reason = F.when(F.col("utr").isNull(), "NARRATION_HAS_NO_UTR").when(F.col("known"), "SETTLEMENT_NOT_MATCHED_TO_BANK").otherwise("UTR_NOT_IN_SETTLEMENT_REPORT")
    return rows.select("bank_row_id", reason.alias("reason"))


def mutual_unique(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with n_left and n_right, how many pairs each side is in, and unique, whether both are one."""
    rows = pairs.withColumn("n_left", F.count("*").over(W.partitionBy(left))).withColumn("n_right", F.count("*").over(W.partitionBy(right)))
    return rows.withColumn("unique", (F.col("n_left") == 1) & (F.col("n_right") == 1))


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: Column, width: int, on: list[str]) -> DataFrame:
    """Rows of left and right, equal in ``on``, whose amounts a and b differ by at most ``tolerance`` (over left).

    Each left row is put into every bucket of ``width`` that its band touches, each right row into its own; the join
    is an equi-join on ``on`` and the bucket.
    """
    bucket = lambda x: F.floor(x / F.lit(width))
    low = left.withColumn("__k", F.explode(F.sequence(bucket(F.col(a) - tolerance), bucket(F.col(a) + tolerance))))
    high = right.withColumn("__k", bucket(F.col(b)))
    return low.join(high, [*on, "__k"]).where(F.abs(F.col(a) - F.col(b)) <= tolerance).drop("__k")


def tolerant_pairs(settlements: DataFrame, credits: DataFrame, shape: Column | None = None) -> DataFrame:
    """Admissible pairs of the tolerant tier: (settlement_id, bank_row_id, rule, delta_paise, confidence, similarity).

    ``settlements``: settlement_id, utr, net_paise, event_date, hi, n_payments. A credit with a reference pairs with
    that reference only; one without pairs by date, amount band and the shape of its narration. ``shape``: the
    similarity, over narration and utr; None takes the narration's own likeness to a payout's.
    """
    from ledgerloom.functions.text import narration_similarity

    s = settlements.select("settlement_id", F.col("utr").alias("utr"), "net_paise", F.col("event_date").alias("lo"), "hi", (F.lit(C.BASE_TOLERANCE) + C.PER_PAYMENT_TOLERANCE * F.col("n_payments")).alias("tolerance"))
    c = credits.select("bank_row_id", F.col("utr").alias("bank_utr"), "credit_paise", F.col("event_date").alias("posted"), "narration")
    by_utr = s.join(c, s["utr"] == c["bank_utr"]).where(F.abs(F.col("credit_paise") - F.col("net_paise")) <= F.col("tolerance")).where("posted between lo and hi")
    by_utr = by_utr.withColumn("similarity", F.lit(100.0))
    days = s.withColumn("posted", F.explode(F.sequence("lo", "hi")))
    near = band_join(days, c.where("bank_utr is null"), "net_paise", "credit_paise", F.col("tolerance"), 512, ["posted"])
    by_shape = near.withColumn("similarity", narration_similarity(F.col("narration"), F.col("utr")) if shape is None else shape).where(F.col("similarity") >= C.SHAPE_THRESHOLD)
    rows = by_utr.select(*by_shape.columns).unionByName(by_shape)
    delta = F.col("credit_paise") - F.col("net_paise")
    conf = F.when(F.col("bank_utr").isNotNull(), C.CONFIDENCE["utr_tolerant"]).when(delta == 0, C.CONFIDENCE["narration_exact"]).otherwise(C.CONFIDENCE["narration_tolerant"])
    rule = F.when(F.col("bank_utr").isNotNull(), "E_UTR_TOLERANT_AMOUNT").otherwise("F_NARRATION_AMOUNT_DATE")
    return rows.select("settlement_id", "bank_row_id", rule.alias("rule"), delta.alias("delta_paise"), conf.alias("confidence"), "similarity")


def tolerant_settlements(settlements: DataFrame, pairs: DataFrame) -> DataFrame:
    """(settlement_id, bank_row_id, reason, rule, confidence) of every settlement of the tier."""
    counted = mutual_unique(pairs, "settlement_id", "bank_row_id")
    own = counted.groupBy("settlement_id").agg(F.count("*").alias("n"), F.max("n_right").alias("n_right"), F.min(F.struct("bank_row_id", "rule", "confidence")).alias("c"))
    rows = settlements.select("settlement_id").join(own, "settlement_id", "left")
    reason = F.when(F.col("n").isNull(), "NO_TOLERANT_CANDIDATE").when(F.col("n") > 1, "AMBIGUOUS_MULTI_CANDIDATE").when(F.col("n_right") > 1, "BANK_ROW_CONTESTED")
    rows = rows.withColumn("reason", reason)
    keep = lambda x: F.when(F.col("reason").isNull(), F.col(f"c.{x}")).alias(x)
    return rows.select("settlement_id", keep("bank_row_id"), "reason", keep("rule"), keep("confidence"))


def unique_by_utr(settlements: DataFrame, credits: DataFrame) -> DataFrame:
    """(settlement_id, bank_row_id): credits that alone carry a settlement's reference."""
    one = credits.where("utr is not null").groupBy("utr").agg(F.count("*").alias("n"), F.min("bank_row_id").alias("bank_row_id")).where("n = 1")
    return settlements.join(one, "utr").select("settlement_id", "bank_row_id")


def zero_payouts(settlements: DataFrame, bank: DataFrame) -> DataFrame:
    """(settlement_id, bank_row_id): zero-value rows for payouts of zero, by reference, else by the same day; unique both ways."""
    rows = bank.where("credit_paise = 0 and debit_paise = 0")
    one = lambda df, key, out: df.groupBy(key).agg(F.count("*").alias("n"), F.min("bank_row_id").alias(out)).where("n = 1").drop("n")
    by_utr = one(rows.where("utr is not null"), "utr", "by_utr")
    by_day = one(rows.where("utr is null"), "event_date", "by_day")
    found = settlements.join(by_utr, "utr", "left").join(by_day, "event_date", "left").select("settlement_id", F.coalesce("by_utr", "by_day").alias("bank_row_id")).where("bank_row_id is not null")
    return mutual_unique(found, "settlement_id", "bank_row_id").where("n_right = 1").select("settlement_id", "bank_row_id")


def net_settlements(batches: DataFrame, credits: DataFrame, utr_pairs: DataFrame, zero_pairs: DataFrame, identified: DataFrame, as_of: Column) -> DataFrame:
    """Verdict of each open batch by its computed net (settlement_id, expected_net_paise, event_date, hi).

    ``identified``: (settlement_id, bank_row_id) that attribution alone explains. Precedence: several candidates,
    a zero payout's own row, a reference's own row, an explained credit, no candidate, one candidate. A row that two
    batches claim is then no one's.
    """
    c = credits.select("bank_row_id", "credit_paise", F.col("event_date").alias("posted"), "utr")
    days = batches.select("settlement_id", "expected_net_paise", F.explode(F.sequence("event_date", "hi")).alias("posted"))
    near = band_join(days, c, "expected_net_paise", "credit_paise", F.lit(C.NET_TOLERANCE), 2 * C.NET_TOLERANCE + 1, ["posted"])
    own = near.groupBy("settlement_id").agg(F.count("*").alias("n"), F.min("bank_row_id").alias("one"))
    ident = identified.groupBy("settlement_id").agg(F.count("*").alias("n_ident"), F.min("bank_row_id").alias("ident"))
    rows = batches.select("settlement_id", "expected_net_paise", "hi").join(own, "settlement_id", "left").join(ident, "settlement_id", "left")
    rows = rows.join(utr_pairs.select("settlement_id", F.col("bank_row_id").alias("by_utr")), "settlement_id", "left").join(zero_pairs.select("settlement_id", F.col("bank_row_id").alias("zero")), "settlement_id", "left")
    rows = rows.fillna(0, ["n", "n_ident"])
    zero = (F.col("expected_net_paise") == 0) & F.col("zero").isNotNull()
    none, asked = F.col("n") == 0, F.col("expected_net_paise") > 0
    way = (
        F.when(F.col("n") > 1, "many").when(zero, "zero").when(none & F.col("by_utr").isNotNull(), "utr")
        .when(none & asked & (F.col("n_ident") > 1), "many").when(none & asked & (F.col("n_ident") == 1), "attribution")
        .when(none & ~asked, "many").when(none & (as_of <= F.col("hi")), "pending").when(none, "missing").otherwise("amount")
    )
    rows = rows.withColumn("way", way)
    row = F.when(F.col("way") == "zero", F.col("zero")).when(F.col("way") == "utr", F.col("by_utr")).when(F.col("way") == "attribution", F.col("ident")).when(F.col("way") == "amount", F.col("one"))
    rows = rows.withColumn("bank_row_id", row)
    claim = F.coalesce(F.col("bank_row_id").cast("string"), F.concat(F.lit("-"), F.col("settlement_id").cast("string")))
    rows = rows.withColumn("contested", F.col("bank_row_id").isNotNull() & (F.count("*").over(W.partitionBy(claim)) > 1))
    outcome = (
        F.when(F.col("contested") | (F.col("way") == "many"), "AMBIGUOUS_MULTI_CANDIDATE").when(F.col("way").isin("zero", "amount"), "MATCHED")
        .when(F.col("way").isin("utr", "attribution"), "AMOUNT_VARIANCE_UNEXPLAINED").when(F.col("way") == "pending", "TIMING_PENDING").otherwise("MISSING_IN_BANK")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("bank_row_id", F.when(~F.col("contested"), F.col("bank_row_id")))
    actual = credits.select("bank_row_id", F.col("credit_paise").alias("actual_paise"))
    rows = rows.join(actual, "bank_row_id", "left")
    variance = F.when(F.col("way") == "zero", 0).otherwise(F.col("actual_paise") - F.col("expected_net_paise"))
    conf = F.when(F.col("outcome") != "MATCHED", 0.0).when(variance == 0, C.CONFIDENCE["equation"]).otherwise(C.CONFIDENCE["drift"])
    by = F.when(F.col("contested"), None).when(F.col("way").isin("zero", "utr"), "utr").when(F.col("way").isin("amount", "attribution"), F.col("way"))
    return rows.select("settlement_id", "expected_net_paise", "outcome", "bank_row_id", variance.cast("long").alias("variance_paise"), conf.alias("confidence"), by.alias("identified_by"))
