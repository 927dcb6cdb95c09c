"""The library's queries over the star-schema tables, each with SQL where SQL can express it."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.config import Rates
from ledgerloom.functions import calendar as cal
from ledgerloom.functions import money, text
from ledgerloom.operators import attribution, batches, exceptions, matching, membership, scoring
from ledgerloom.plans import views
from ledgerloom.plans.reconcile import reconcile
from ledgerloom.sources.checkpoints import shared_root
from ledgerloom.sources.star import STAR_SQL, star_ledgers, table
from ledgerloom.streaming.exact import as_stream, drain, exact_stream

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, star: bool = True):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {STAR_SQL} {sql}" if star else sql
        return f

    return put


def days(spark) -> DataFrame:
    return cal.business_calendar(spark, date(1994, 1, 1), date(2025, 12, 31))


def built(l) -> DataFrame:
    return batches.build_batches(l.settlements, l.payments, l.refunds, l.chargebacks, Rates())


def due(spark, s: DataFrame, n: int) -> DataFrame:
    return cal.add_business_days(s, days(spark), "event_date", n, "hi")


def credits_of(l) -> DataFrame:
    return l.bank.where("entry_type = 'bank_credit'")


def shape(narration: Column, utr: Column) -> Column:
    """Likeness for narrations that are a payout's, clipped: whole or nothing, without Python."""
    whole = F.concat(F.lit(text.TEMPLATES[2].removesuffix("{utr}")), utr)
    return F.when(F.startswith(whole, narration) & (F.length(narration) > 0), 100.0).otherwise(0.0)


HI = "JOIN cal_ k ON k.day = s.event_date JOIN biz_ b ON b.seq = k.start + {n}"


@query("""SELECT settlement_id, n_payments::BIGINT AS n_payments, gross_paise AS own_gross, fee_paise AS own_fee, tax_paise AS own_tax, withholding_paise AS own_withholding,
  refund_paise AS own_refund, chargeback_paise AS own_chargeback, net_paise AS expected_net_paise, carry_out AS own_carry_out FROM settlements_""")
def settlement_rebuild(spark, sf_dir):
    b = built(star_ledgers(spark, sf_dir))
    return b.select("settlement_id", "n_payments", "own_gross", "own_fee", "own_tax", "own_withholding", "own_refund", "own_chargeback", "expected_net_paise", "own_carry_out")


@query("SELECT count(*)::BIGINT AS total, count(*)::BIGINT AS exact FROM settlements_")
def self_check(spark, sf_dir):
    return batches.self_check(built(star_ledgers(spark, sf_dir)))


GATES_SQL = """, n_ AS (SELECT order_id, count(*) AS n, min(payment_id) AS payment_id FROM payments_ GROUP BY 1),
gates_ AS (SELECT o.order_id, o.amount_paise, coalesce(n, 0)::BIGINT AS n_payments, CASE WHEN n IS NULL THEN 'NO_PAYMENT_FOR_ORDER' WHEN n > 1 THEN 'MULTIPLE_PAYMENTS_FOR_ORDER'
  WHEN p.amount_paise <> o.amount_paise THEN 'ORDER_PAYMENT_AMOUNT_MISMATCH' WHEN p.payment_id IN (SELECT payment_id FROM chargebacks_) THEN 'PAYMENT_HAS_CHARGEBACK' END AS gate,
  CASE WHEN n = 1 THEN p.settlement_id END AS settlement_id
  FROM orders_ o LEFT JOIN n_ USING (order_id) LEFT JOIN payments_ p ON p.payment_id = n_.payment_id)"""


@query(f"{GATES_SQL} SELECT order_id, n_payments, gate, settlement_id FROM gates_")
def order_gate_reasons(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    return matching.order_gates(l.orders, l.payments, l.chargebacks).select("order_id", "n_payments", "gate", "settlement_id")


EXACT_SQL = f""", exact_ AS (
  SELECT s.settlement_id, CASE WHEN count(c.bank_row_id) = 0 THEN 'NO_BANK_CREDIT_WITH_UTR' WHEN count(*) FILTER (c.credit_paise = net_paise) = 0 THEN 'AMOUNT_MISMATCH'
    WHEN count(*) FILTER (c.credit_paise = net_paise AND c.event_date BETWEEN s.event_date AND b.day) = 0 THEN 'OUTSIDE_POSTING_WINDOW'
    WHEN count(*) FILTER (c.credit_paise = net_paise AND c.event_date BETWEEN s.event_date AND b.day) > 1 THEN 'AMBIGUOUS_MULTI_CANDIDATE' END AS reason,
    min(c.bank_row_id) FILTER (c.credit_paise = net_paise AND c.event_date BETWEEN s.event_date AND b.day) AS row
  FROM settlements_ s {HI.format(n=3)} LEFT JOIN credits_ c ON c.utr = s.utr GROUP BY s.settlement_id)"""


@query(f"{EXACT_SQL} SELECT settlement_id, CASE WHEN reason IS NULL THEN row END AS bank_row_id, reason FROM exact_")
def exact_match_staircase(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    return matching.exact_settlements(due(spark, l.settlements, 3), credits_of(l))


@query(f"""{EXACT_SQL} SELECT bank_row_id, CASE WHEN utr IS NULL THEN 'NARRATION_HAS_NO_UTR' WHEN utr IN (SELECT utr FROM settlements_) THEN 'SETTLEMENT_NOT_MATCHED_TO_BANK' ELSE 'UTR_NOT_IN_SETTLEMENT_REPORT' END AS reason
  FROM credits_ WHERE bank_row_id NOT IN (SELECT row FROM exact_ WHERE reason IS NULL)""")
def credit_declines(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    return matching.credit_declines(credits_of(l), matching.exact_settlements(due(spark, l.settlements, 3), credits_of(l)), l.settlements)


@query(f"{EXACT_SQL} SELECT reason, count(*)::BIGINT AS n FROM exact_ WHERE reason IS NOT NULL GROUP BY reason")
def decline_histogram(spark, sf_dir):
    return exact_match_staircase(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


TOLERANT_SQL = f""", tol_ AS (
  SELECT s.settlement_id, c.bank_row_id, CASE WHEN c.utr IS NOT NULL THEN 'E_UTR_TOLERANT_AMOUNT' ELSE 'F_NARRATION_AMOUNT_DATE' END AS rule, c.credit_paise - s.net_paise AS delta_paise,
    CASE WHEN c.utr IS NOT NULL THEN 0.9::DOUBLE WHEN c.credit_paise = s.net_paise THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS confidence
  FROM settlements_ s {HI.format(n=6)} JOIN credits_ c ON c.event_date BETWEEN s.event_date AND b.day AND abs(c.credit_paise - s.net_paise) <= 2 + s.n_payments
  WHERE c.utr = s.utr OR (c.utr IS NULL AND starts_with('NEFT CR-RATN0000088-RAZORPAY SOFTWARE PVT LTD-' || s.utr, c.narration)))"""


def star_tolerant(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    n = l.payments.where("settlement_id is not null").groupBy("settlement_id").agg(F.count("*").alias("n_payments"))
    s = due(spark, l.settlements.join(n, "settlement_id", "left").fillna(0, ["n_payments"]), 6)
    return l, matching.tolerant_pairs(s, credits_of(l), shape(F.col("narration"), F.col("utr")))


@query(f"{TOLERANT_SQL} SELECT * FROM tol_")
def tolerant_pairs(spark, sf_dir):
    return star_tolerant(spark, sf_dir)[1].drop("similarity")


@query(f"""{TOLERANT_SQL}, n_ AS (SELECT *, count(*) OVER (PARTITION BY settlement_id) AS nl, count(*) OVER (PARTITION BY bank_row_id) AS nr FROM tol_)
  SELECT settlement_id, bank_row_id, nl::BIGINT AS n_left, nr::BIGINT AS n_right, nl = 1 AND nr = 1 AS "unique" FROM n_""")
def mutual_unique_match(spark, sf_dir):
    pairs = star_tolerant(spark, sf_dir)[1]
    return matching.mutual_unique(pairs, "settlement_id", "bank_row_id").select("settlement_id", "bank_row_id", "n_left", "n_right", "unique")


@query(f"""{TOLERANT_SQL}, n_ AS (SELECT *, count(*) OVER (PARTITION BY settlement_id) AS nl, count(*) OVER (PARTITION BY bank_row_id) AS nr FROM tol_),
  m_ AS (SELECT settlement_id, max(nl) AS nl, max(nr) AS nr, min(bank_row_id) AS row, min(rule) AS rule, min(confidence) AS confidence FROM n_ GROUP BY 1)
  SELECT s.settlement_id, CASE WHEN nl = 1 AND nr = 1 THEN row END AS bank_row_id, CASE WHEN nl IS NULL THEN 'NO_TOLERANT_CANDIDATE' WHEN nl > 1 THEN 'AMBIGUOUS_MULTI_CANDIDATE' WHEN nr > 1 THEN 'BANK_ROW_CONTESTED' END AS reason,
    CASE WHEN nl = 1 AND nr = 1 THEN rule END AS rule, CASE WHEN nl = 1 AND nr = 1 THEN confidence END AS confidence FROM settlements_ s LEFT JOIN m_ USING (settlement_id)""")
def tolerant_settlements(spark, sf_dir):
    l, pairs = star_tolerant(spark, sf_dir)
    return matching.tolerant_settlements(l.settlements, pairs)


@query(r"SELECT bank_row_id, nullif(regexp_extract(upper(narration), '(^|[^A-Z0-9])([A-Z]{4}[0-9]{12})([^0-9]|$)', 2), '') AS utr FROM bank_")
def utr_extract(spark, sf_dir):
    return star_ledgers(spark, sf_dir).bank.select("bank_row_id", text.extract_utr(F.col("narration")).alias("utr"))


@query("SELECT s.settlement_id, min(c.bank_row_id) AS bank_row_id FROM settlements_ s JOIN credits_ c USING (utr) GROUP BY s.settlement_id HAVING count(*) = 1")
def utr_unique_pairing(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    return matching.unique_by_utr(l.settlements, credits_of(l))


ZERO_SQL = """, z_ AS (SELECT * FROM bank_ WHERE credit_paise = 0 AND debit_paise = 0),
u_ AS (SELECT utr, min(bank_row_id) AS r FROM z_ WHERE utr IS NOT NULL GROUP BY 1 HAVING count(*) = 1), d_ AS (SELECT event_date, min(bank_row_id) AS r FROM z_ WHERE utr IS NULL GROUP BY 1 HAVING count(*) = 1),
zp_ AS (SELECT settlement_id, coalesce(u_.r, d_.r) AS bank_row_id FROM settlements_ s LEFT JOIN u_ USING (utr) LEFT JOIN d_ ON d_.event_date = s.event_date WHERE net_paise = 0),
zero_ AS (SELECT min(settlement_id) AS settlement_id, bank_row_id FROM zp_ WHERE bank_row_id IS NOT NULL GROUP BY bank_row_id HAVING count(*) = 1)"""


@query(f"{ZERO_SQL} SELECT settlement_id, bank_row_id FROM zero_")
def zero_value_pairing(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    return matching.zero_payouts(l.settlements.where("net_paise = 0"), l.bank)


@query(f"""{ZERO_SQL}, up_ AS (SELECT s.settlement_id, min(c.bank_row_id) AS r FROM settlements_ s JOIN credits_ c USING (utr) GROUP BY 1 HAVING count(*) = 1),
  near_ AS (SELECT s.settlement_id, count(*) AS n, min(c.bank_row_id) AS one FROM settlements_ s {HI.format(n=3)} JOIN credits_ c ON c.event_date BETWEEN s.event_date AND b.day AND abs(c.credit_paise - s.net_paise) <= 2 GROUP BY 1),
  way_ AS (SELECT s.settlement_id, s.net_paise, b.day AS hi, CASE WHEN n > 1 THEN 'many' WHEN net_paise = 0 AND z.bank_row_id IS NOT NULL THEN 'zero' WHEN n IS NULL AND up_.r IS NOT NULL THEN 'utr' WHEN n IS NULL AND net_paise = 0 THEN 'many'
    WHEN n IS NULL AND DATE '1998-06-30' <= b.day THEN 'pending' WHEN n IS NULL THEN 'missing' ELSE 'amount' END AS way, z.bank_row_id AS z, up_.r AS u, one
    FROM settlements_ s {HI.format(n=3)} LEFT JOIN near_ USING (settlement_id) LEFT JOIN zero_ z USING (settlement_id) LEFT JOIN up_ USING (settlement_id)),
  row_ AS (SELECT *, CASE way WHEN 'zero' THEN z WHEN 'utr' THEN u WHEN 'amount' THEN one END AS row FROM way_),
  claim_ AS (SELECT *, row IS NOT NULL AND count(*) OVER (PARTITION BY row) > 1 AS contested FROM row_)
  SELECT settlement_id, CASE WHEN contested OR way = 'many' THEN 'AMBIGUOUS_MULTI_CANDIDATE' WHEN way IN ('zero', 'amount') THEN 'MATCHED' WHEN way = 'utr' THEN 'AMOUNT_VARIANCE_UNEXPLAINED' WHEN way = 'pending' THEN 'TIMING_PENDING' ELSE 'MISSING_IN_BANK' END AS outcome,
    CASE WHEN NOT contested THEN row END AS bank_row_id, CASE WHEN NOT contested THEN c.credit_paise - net_paise END AS variance_paise FROM claim_ LEFT JOIN bank_ c ON c.bank_row_id = row""")
def net_verdicts(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    b = due(spark, built(l), 3)
    none = spark.createDataFrame([], "settlement_id string, bank_row_id string")
    rows = credits_of(l).unionByName(l.bank.where("credit_paise = 0 and debit_paise = 0"))
    zero = matching.zero_payouts(b.where("expected_net_paise = 0"), l.bank)
    v = matching.net_settlements(b, credits_of(l), matching.unique_by_utr(b, credits_of(l)), zero, none, F.lit("1998-06-30").cast("date"))
    z = v.join(rows.select("bank_row_id", F.col("credit_paise").alias("c")), "bank_row_id", "left")
    return z.select("settlement_id", "outcome", "bank_row_id", (F.col("c") - F.col("expected_net_paise")).alias("variance_paise"))


GAPS_SQL = """, gaps_ AS (SELECT settlement_id || '/' || bank_row_id AS gap_id, settlement_id, supp, net_paise - credit_paise AS delta FROM settlements_ s JOIN credits_ c USING (utr) WHERE abs(net_paise - credit_paise) > 2),
items_ AS (SELECT payment_id AS item_id, 'payment' AS kind, amount_paise - fee_paise - tax_paise - (amount_paise * 100 + 5000) // 10000 AS magnitude, settlement_id AS item_settlement, supp FROM payments_
  UNION ALL SELECT item_id, 'refund', amount_paise, settlement_id, supp FROM refunds_ UNION ALL SELECT item_id, 'chargeback', amount_paise, settlement_id, supp FROM chargebacks_)"""
#: In the star queries a gap is explained by items of its own supplier, within five rupees, so that some are.
WIDE = 200_00


def star_gaps(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    c = credits_of(l).where("utr is not null").select("utr", "bank_row_id", "credit_paise")
    gaps = l.settlements.join(c, "utr").select(F.concat_ws("/", "settlement_id", "bank_row_id").alias("gap_id"), "settlement_id", "supp", (F.col("net_paise") - F.col("credit_paise")).alias("delta")).where("abs(delta) > 2")
    supp = lambda df, key: df.select(F.col(key).alias("item_id"), "supp")
    who = supp(l.payments, "payment_id").unionByName(supp(l.refunds, "item_id")).unionByName(supp(l.chargebacks, "item_id"))
    items = attribution.item_pool(l.payments, l.refunds, l.chargebacks, Rates().withholding_bps)
    return gaps, items.join(who, "item_id")


@query(f"""{GAPS_SQL} SELECT gap_id, CASE kind WHEN 'payment' THEN 'L1' WHEN 'refund' THEN 'L2' ELSE 'L3' END AS level, item_id, kind, abs(delta) - magnitude AS residual
  FROM gaps_ g JOIN items_ i USING (supp) WHERE abs(abs(delta) - magnitude) <= {WIDE} AND g.settlement_id IS DISTINCT FROM i.item_settlement""")
def band_join_single(spark, sf_dir):
    gaps, items = star_gaps(spark, sf_dir)
    return attribution.single_candidates(gaps, items, WIDE, ["supp"])


@query(f"""{GAPS_SQL}, g2_ AS (SELECT * REPLACE (delta * 400 AS delta) FROM gaps_)
  SELECT DISTINCT gap_id, least(a.item_id, b.item_id) AS item_a, greatest(a.item_id, b.item_id) AS item_b, abs(delta) - a.magnitude - b.magnitude AS residual
  FROM g2_ g JOIN items_ a USING (supp) JOIN items_ b ON b.supp = g.supp AND a.item_id < b.item_id
  WHERE abs(abs(delta) - a.magnitude - b.magnitude) <= {WIDE} AND g.settlement_id IS DISTINCT FROM a.item_settlement AND g.settlement_id IS DISTINCT FROM b.item_settlement""")
def band_join_pairs(spark, sf_dir):
    gaps, items = star_gaps(spark, sf_dir)
    return attribution.pair_candidates(gaps.withColumn("delta", F.col("delta") * 400), items, WIDE, ["supp"])


@query(f"""{GAPS_SQL}, r_ AS (SELECT *, greatest(1, abs(delta) // 2) AS lo, greatest(greatest(1, abs(delta) // 2) + 1, abs(delta) * 3 // 2) AS hi FROM gaps_),
  e_ AS (SELECT gap_id, kind, count(*)::BIGINT AS n, (sum(greatest(0, least(hi - 1, abs(magnitude) + {WIDE}) - greatest(lo, abs(magnitude) - {WIDE}) + 1))::DOUBLE / (any_value(hi) - any_value(lo))) AS x
    FROM r_ g JOIN items_ i USING (supp) WHERE g.settlement_id IS DISTINCT FROM i.item_settlement GROUP BY 1, 2)
  SELECT gap_id, kind, n, round(x * 1000000)::BIGINT AS expected_micro, CASE WHEN x < 0.01 THEN 'STRONG' WHEN x < 1 THEN 'CIRCUMSTANTIAL' ELSE 'REFUSE' END AS band FROM e_""")
def evidence_bands(spark, sf_dir):
    gaps, items = star_gaps(spark, sf_dir)
    fits = attribution.single_fits(gaps, items, WIDE, ["supp"])
    return fits.select("gap_id", "kind", "n", F.round(F.col("expected") * 1000000).cast("long").alias("expected_micro"), attribution.band(F.col("expected")).alias("band"))


@query("""SELECT item_id, min_by(s.settlement_id, (s.event_date, s.settlement_id)) AS settlement_id FROM refunds_ r LEFT JOIN settlements_ s ON s.supp = r.supp AND s.event_date >= r.event_date GROUP BY item_id""")
def asof_next_cycle(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    return batches.next_cycle(l.refunds.select("supp", "item_id", "event_date"), l.settlements.select("supp", "settlement_id", "event_date"), "supp", "item_id", "event_date", "event_date", "settlement_id")


@query("""SELECT order_id, b0.day AS rolled, b2.day AS plus_two, (k2.seq - k.seq)::BIGINT AS between_days FROM orders_ o JOIN cal_ k ON k.day = o.event_date JOIN biz_ b0 ON b0.seq = k.start JOIN biz_ b2 ON b2.seq = k.start + 2 JOIN cal_ k2 ON k2.day = b2.day""")
def business_days(spark, sf_dir):
    c, o = days(spark), star_ledgers(spark, sf_dir).orders.select("order_id", "event_date")
    o = cal.add_business_days(cal.add_business_days(o, c, "event_date", 0, "rolled"), c, "event_date", 2, "plus_two")
    return cal.business_days_between(o, c, "event_date", "plus_two", "between_days").select("order_id", "rolled", "plus_two", "between_days")


@query("SELECT CASE WHEN hour(ts) >= 23 THEN ts::DATE + 1 ELSE ts::DATE END AS batch_day, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS paise FROM events GROUP BY 1", star=False)
def cutoff_bucket(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(cal.capture_day(F.col("ts"), 23).alias("batch_day")).agg(F.count("*").alias("n"), F.sum(money.from_float(F.col("value"))).alias("paise"))


def flows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = money.from_float(F.col("value"))
    return e.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 2 == 0, p).otherwise(0).alias("credit_paise"), F.when(F.col("event_id") % 2 == 1, p).otherwise(0).alias("debit_paise"))


FLOWS = "WITH f AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * round(value * 100)::BIGINT AS x FROM events)"


@query(f"{FLOWS} SELECT event_id, (500000000 + sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running_paise FROM f", star=False)
def running_balance(spark, sf_dir):
    return batches.running_balance(flows(spark, sf_dir), ["user_id"], ["ts", "event_id"], 500_000_000).select("event_id", "running_paise")


@query(f"""{FLOWS}, l AS (SELECT user_id, list(x ORDER BY ts, event_id) AS xs, list(event_id ORDER BY ts, event_id) AS ids FROM f GROUP BY 1),
  s AS (SELECT user_id, ids, xs, [list_reduce(list_concat([0::BIGINT], xs[1:i]), lambda c, x: greatest(0, c - x)) for i in range(1, len(xs) + 1)] AS cs FROM l),
  u AS (SELECT unnest(ids) AS event_id, unnest(cs) AS carry_out, unnest(list_concat([0::BIGINT], cs[1:len(cs) - 1])) AS carry_in, unnest(xs) AS x FROM s)
  SELECT event_id, carry_in::BIGINT AS carry_in, carry_out::BIGINT AS carry_out, greatest(0, x - carry_in)::BIGINT AS payout FROM u""", star=False)
def carry_forward(spark, sf_dir):
    f = flows(spark, sf_dir).withColumn("raw", F.col("credit_paise") - F.col("debit_paise"))
    return batches.carry_forward(f, ["user_id"], ["ts", "event_id"], "raw").select("event_id", "carry_in", "carry_out", "payout")


@query("SELECT user_id, count(*) FILTER (d < 0)::BIGINT AS back, max(d)::BIGINT AS longest_days FROM (SELECT user_id, date_diff('day', lag(ts::DATE) OVER w, ts::DATE) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id", star=False)
def monotonic_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    gap = F.date_diff(F.to_date("ts"), F.lag(F.to_date("ts")).over(W.partitionBy("user_id").orderBy("event_id")))
    return e.withColumn("d", gap).groupBy("user_id").agg(F.count_if(F.col("d") < 0).alias("back"), F.max("d").cast("long").alias("longest_days"))


@query("""SELECT user_id, event_id, event_type, (n - 1)::BIGINT AS duplicates FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE r = 1""", star=False)
def first_decision_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    return scoring.first_decision(e, "k", "event_id").select("user_id", "event_id", "event_type", "duplicates")


@query("SELECT user_id, max_by(event_type, event_id) AS reason, min_by(event_type, event_id) AS first_reason FROM events GROUP BY 1", star=False)
def latest_reason(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("reason"), F.min_by("event_type", "event_id").alias("first_reason"))


TYPED_SQL = f"""{GATES_SQL}, typed_ AS (SELECT order_id, amount_paise, gate AS reason, CASE gate WHEN 'NO_PAYMENT_FOR_ORDER' THEN 'ORDER_UNPAID' WHEN 'MULTIPLE_PAYMENTS_FOR_ORDER' THEN 'DUPLICATE_PAYMENT'
  WHEN 'ORDER_PAYMENT_AMOUNT_MISMATCH' THEN 'AMOUNT_VARIANCE_UNEXPLAINED' WHEN 'PAYMENT_HAS_CHARGEBACK' THEN 'CHARGEBACK_UNPOSTED' ELSE 'UNKNOWN' END AS code FROM gates_ WHERE gate IS NOT NULL)"""


def star_typed(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    g = matching.order_gates(l.orders, l.payments, l.chargebacks).where("gate is not null")
    d = g.select(F.lit(1).alias("tier"), F.col("order_id").alias("entity_id"), F.lit("orders").alias("kind"), F.col("gate").alias("reason"), F.lit(None).cast("string").alias("caused_by"))
    return exceptions.typed(g.select("order_id", "amount_paise", "event_date"), exceptions.merge_declines(d))


@query(f"{TYPED_SQL} SELECT code AS group_key, code, count(*)::BIGINT AS chain_count, sum(amount_paise)::BIGINT AS total_paise, min(order_id) AS first_order FROM typed_ GROUP BY code")
def exception_groups(spark, sf_dir):
    g = exceptions.groups(star_typed(spark, sf_dir))
    return g.select("group_key", "code", "chain_count", "total_paise", "first_order")


@query(f"{TYPED_SQL} SELECT code AS group_key, order_id FROM typed_")
def group_members(spark, sf_dir):
    return exceptions.members(star_typed(spark, sf_dir))


@query(f"""{TYPED_SQL}, b_ AS (SELECT 'code' AS dimension, code AS value, amount_paise FROM typed_ UNION ALL SELECT 'reason', reason, amount_paise FROM typed_)
  SELECT dimension, value, count(*)::BIGINT AS findings, sum(amount_paise)::BIGINT AS paise, round(10000.0 * sum(amount_paise) / sum(sum(amount_paise)) OVER (PARTITION BY dimension))::BIGINT AS share_bps FROM b_ GROUP BY 1, 2""")
def queue_breakdown(spark, sf_dir):
    b = exceptions.breakdown(star_typed(spark, sf_dir), ["code", "reason"], "amount_paise")
    return b.select("dimension", "value", "findings", "paise", F.round(F.col("share") * 10000).cast("long").alias("share_bps"))


@query(f"{TYPED_SQL} SELECT order_id, code, amount_paise FROM typed_ ORDER BY amount_paise DESC, order_id LIMIT 10")
def topk_queue(spark, sf_dir):
    return star_typed(spark, sf_dir).orderBy(F.desc("amount_paise"), "order_id").limit(10).select("order_id", "code", "amount_paise")


FINDING_SQL = f"""{EXACT_SQL}, f_ AS (SELECT settlement_id, CASE reason WHEN 'NO_BANK_CREDIT_WITH_UTR' THEN 'MISSING_IN_BANK' WHEN 'OUTSIDE_POSTING_WINDOW' THEN 'TIMING_PENDING' ELSE reason END AS code FROM exact_ WHERE reason IS NOT NULL),
  c_ AS (SELECT net_paise, CASE WHEN code IS NULL THEN 'confirmed' WHEN code = 'MISSING_IN_BANK' THEN 'at_risk' WHEN code = 'TIMING_PENDING' THEN 'expected' ELSE 'disputed' END AS bucket FROM settlements_ LEFT JOIN f_ USING (settlement_id))"""


@query(f"{FINDING_SQL} SELECT bucket, count(net_paise)::BIGINT AS payouts, coalesce(sum(CASE WHEN bucket = 'disputed' THEN 5000 ELSE net_paise END), 0)::BIGINT AS paise FROM c_ GROUP BY 1")
def cash_position(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    e = matching.exact_settlements(due(spark, l.settlements, 3), credits_of(l)).where("reason is not null")
    code = F.when(F.col("reason") == "NO_BANK_CREDIT_WITH_UTR", "MISSING_IN_BANK").when(F.col("reason") == "OUTSIDE_POSTING_WINDOW", "TIMING_PENDING").otherwise(F.col("reason"))
    found = e.select("settlement_id", code.alias("code"), F.lit(5000).cast("long").alias("paise"))
    return exceptions.cash_position(exceptions.cash_rows(l.settlements.select("settlement_id", "net_paise"), found))


DECIDED_SQL = f"{GATES_SQL}, truth_ AS (SELECT order_id, CASE WHEN ord % 5 = 0 THEN 'ORDER_UNPAID' ELSE 'MATCHED' END AS expected FROM orders_), said_ AS (SELECT order_id, CASE WHEN gate IS NULL THEN 'MATCHED' WHEN gate = 'NO_PAYMENT_FOR_ORDER' THEN 'ORDER_UNPAID' ELSE 'UNKNOWN' END AS outcome FROM gates_), both_ AS (SELECT * FROM truth_ LEFT JOIN said_ USING (order_id))"


def star_decided(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    g = matching.order_gates(l.orders, l.payments, l.chargebacks)
    outcome = F.when(F.col("gate").isNull(), "MATCHED").when(F.col("gate") == "NO_PAYMENT_FOR_ORDER", "ORDER_UNPAID").otherwise("UNKNOWN")
    return g.select("order_id", outcome.alias("outcome")), l.orders.select("order_id", F.when(F.col("ord") % 5 == 0, "ORDER_UNPAID").otherwise("MATCHED").alias("expected"))


@query(f"""{DECIDED_SQL} SELECT count(*)::BIGINT AS orders, count(*) FILTER (outcome = 'MATCHED')::BIGINT AS claims, count(*) FILTER (outcome = 'MATCHED' AND expected = 'MATCHED')::BIGINT AS right_claims,
  count(*) FILTER (outcome = 'MATCHED') / count(*) AS coverage, count(*) FILTER (outcome = 'MATCHED' AND expected = 'MATCHED') / nullif(count(*) FILTER (outcome = 'MATCHED'), 0) AS precision,
  count(*) FILTER (outcome = 'MATCHED' AND expected = 'MATCHED') / nullif(count(*) FILTER (expected = 'MATCHED'), 0) AS recall,
  count(*) FILTER (expected <> 'MATCHED' AND outcome = expected) / nullif(count(*) FILTER (expected <> 'MATCHED'), 0) AS exception_accuracy FROM both_""")
def score_report(spark, sf_dir):
    return scoring.score(*star_decided(spark, sf_dir))


@query(f"{DECIDED_SQL} SELECT expected, outcome, count(*)::BIGINT AS n FROM both_ GROUP BY ALL")
def score_confusion(spark, sf_dir):
    return scoring.confusion(*star_decided(spark, sf_dir))


@query("""WITH a AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS x, list_sort(list_distinct(list(l_suppkey) FILTER (l_linenumber <> 7))) AS y FROM lineitem GROUP BY 1)
  SELECT l_orderkey, coalesce(len(y), 0) = 0 OR x = y AS same FROM a""", star=False)
def set_equality_linkage(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("x"), F.collect_set(F.when(F.col("l_linenumber") != 7, F.col("l_suppkey"))).alias("y"))
    return a.select("l_orderkey", scoring.same_items(F.col("y"), F.col("x")).alias("same"))


@query("""WITH r AS (SELECT user_id, count(*) AS m FROM events GROUP BY 1) SELECT min(m)::BIGINT AS lo, max(m)::BIGINT AS hi, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd, (SELECT min(user_id) FROM r WHERE m = (SELECT min(m) FROM r)) AS worst FROM r""", star=False)
def population_stats(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("m"))
    # ties to the smaller run
    s = scoring.run_statistics(r, "m", "user_id").drop("worst").withColumns({c: F.round(c, 6) for c in ("mean", "sd")})
    worst = r.orderBy("m", "user_id").limit(1).select(F.col("user_id").alias("worst"))
    return s.join(F.broadcast(worst))


@query("SELECT event_type, round(avg(round(value * 100)::BIGINT), 4) AS mean, round(stddev_samp(round(value * 100)::BIGINT), 4) AS sd, count(*)::BIGINT AS n FROM events GROUP BY 1", star=False)
def sensitivity_stats(spark, sf_dir):
    p = money.from_float(F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_samp(p), 4).alias("sd"), F.count("*").alias("n"))


@query("""SELECT k AS band, sum(v)::BIGINT AS total FROM (SELECT unnest(json_keys(props::JSON)) AS k, props FROM events), LATERAL (SELECT (props::JSON ->> k)::BIGINT AS v) GROUP BY 1""", star=False)
def json_band_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,bigint>")).alias("band", "v"))
    return e.groupBy("band").agg(F.sum("v").alias("total"))


@query("""SELECT event_date, count(*)::BIGINT AS near FROM (SELECT event_date, lead(net_paise) OVER (PARTITION BY event_date ORDER BY net_paise, settlement_id) - net_paise AS d FROM settlements_) WHERE d <= 100000 GROUP BY 1""")
def near_collisions(spark, sf_dir):
    s = star_ledgers(spark, sf_dir).settlements
    d = F.lead("net_paise").over(W.partitionBy("event_date").orderBy("net_paise", "settlement_id")) - F.col("net_paise")
    return s.withColumn("d", d).where("d <= 100000").groupBy("event_date").agg(F.count("*").alias("near"))


@query("""SELECT c.bank_row_id, count(*)::BIGINT AS nets FROM credits_ c JOIN settlements_ s ON abs(c.credit_paise - s.net_paise) <= 50000 AND last_day(c.event_date - 9) = s.event_date GROUP BY 1 HAVING count(*) >= 2""")
def multi_net_hits(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    c = credits_of(l).select("bank_row_id", "credit_paise", F.last_day(F.date_sub("event_date", 9)).alias("event_date"))
    hits = matching.band_join(c, l.settlements.select("net_paise", "event_date"), "credit_paise", "net_paise", F.lit(50000), 100001, ["event_date"])
    return hits.groupBy("bank_row_id").agg(F.count("*").alias("nets")).where("nets >= 2")


@query("""SELECT 'payment_order' AS "check", count(*)::BIGINT AS failures FROM payments_ WHERE order_id NOT IN (SELECT order_id FROM orders_) UNION ALL
  SELECT 'refund_payment', count(*)::BIGINT FROM refunds_ WHERE payment_id NOT IN (SELECT payment_id FROM payments_) UNION ALL
  SELECT 'both_refund_and_chargeback', count(*)::BIGINT FROM (SELECT payment_id FROM refunds_ INTERSECT SELECT payment_id FROM chargebacks_)""")
def ref_integrity(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    one = lambda name, df: df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
    out = one("payment_order", l.payments.join(l.orders, "order_id", "left_anti"))
    out = out.unionByName(one("refund_payment", l.refunds.join(l.payments.select("payment_id"), "payment_id", "left_anti")))
    return out.unionByName(one("both_refund_and_chargeback", l.refunds.select("payment_id").intersect(l.chargebacks.select("payment_id"))))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", star=False)
def dup_ids(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100", star=False)
def page_window(spark, sf_dir):
    return views.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 50)


@query("""SELECT o.order_id, p.payment_id, p.settlement_id, c.bank_row_id FROM orders_ o LEFT JOIN payments_ p USING (order_id) LEFT JOIN settlements_ s ON s.settlement_id = p.settlement_id LEFT JOIN credits_ c ON c.utr = s.utr""")
def chain_walk(spark, sf_dir):
    return views.chains(star_ledgers(spark, sf_dir)).select("order_id", "payment_id", "settlement_id", "bank_row_id")


@query("SELECT source, count(*)::BIGINT AS n, sum(a)::BIGINT AS signed_paise FROM (SELECT 'orders' AS source, amount_paise AS a FROM orders_ UNION ALL SELECT 'payments', amount_paise FROM payments_ UNION ALL SELECT 'refunds', -amount_paise FROM refunds_ UNION ALL SELECT 'chargebacks', -amount_paise FROM chargebacks_ UNION ALL SELECT 'settlements', net_paise FROM settlements_ UNION ALL SELECT 'bank', credit_paise - debit_paise FROM bank_) GROUP BY 1")
def ledger_entries(spark, sf_dir):
    return star_ledgers(spark, sf_dir).entries().groupBy("source").agg(F.count("*").alias("n"), F.sum("signed_paise").alias("signed_paise"))


@query(r"""WITH p AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS p FROM orders)
  SELECT o_orderkey, (p * 180 + 5000) // 10000 AS fee, p // 100 || '.' || lpad((p % 100)::VARCHAR, 2, '0') AS rupees,
    '₹' || CASE WHEN p // 100 < 1000 THEN (p // 100)::VARCHAR WHEN p // 100 < 100000 THEN (p // 100) // 1000 || ',' || lpad((p // 100 % 1000)::VARCHAR, 3, '0')
      ELSE (p // 100) // 100000 || ',' || lpad((p // 100 // 1000 % 100)::VARCHAR, 2, '0') || ',' || lpad((p // 100 % 1000)::VARCHAR, 3, '0') END || '.' || lpad((p % 100)::VARCHAR, 2, '0') AS inr FROM p""", star=False)
def money_formats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", money.from_float(F.col("o_totalprice")).alias("p"))
    back = money.parse_paise(money.format_rupees(F.col("p")))
    return o.select("o_orderkey", money.apply_bps(back, 180).alias("fee"), money.format_rupees(F.col("p")).alias("rupees"), money.format_inr(F.col("p")).alias("inr"))


@query("""SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL
  SELECT 'except', count(*)::BIGINT FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL
  SELECT 'intersect', count(*)::BIGINT FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
  SELECT 'residue', count(*)::BIGINT FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""", star=False)
def set_operations(spark, sf_dir):
    c, s, o = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    a, b = c.select("c_nationkey"), s.select("s_nationkey")
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    out = one("union", a.union(b)).unionByName(one("except", a.exceptAll(b))).unionByName(one("intersect", a.intersect(b)))
    return out.unionByName(one("residue", c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti")))


@query("""SELECT 'equation' AS "check", true AS passed, 0::BIGINT AS failures FROM (SELECT 1) UNION ALL SELECT 'net_not_negative', true, 0::BIGINT UNION ALL SELECT 'below_gross', count(*) FILTER (net_paise > gross_paise) = 0, count(*) FILTER (net_paise > gross_paise)::BIGINT FROM settlements_""")
def invariants(spark, sf_dir):
    s = star_ledgers(spark, sf_dir).settlements
    c = F.col
    eq = c("gross_paise") - c("fee_paise") - c("tax_paise") - c("refund_paise") - c("chargeback_paise") - c("withholding_paise") - c("carry_forward_in_paise") + c("carry_forward_out_paise") == c("net_paise")
    return scoring.checks(s, "settlements", {"equation": eq, "net_not_negative": c("net_paise") >= 0, "below_gross": c("net_paise") <= c("gross_paise")}).drop("section")


@query(rf"""WITH a AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '{text.MONEY}', 0), lambda x: rtrim(regexp_replace(x, '^(?:Rs\.?|₹|INR)\s*|,', '', 'g'), '.'))) AS m, list_distinct(regexp_extract_all(text, '{text.ID}', 0)) AS i FROM documents)
  SELECT doc_id, len(m)::BIGINT AS amounts, len(i)::BIGINT AS ids FROM a WHERE len(m) + len(i) > 0""", star=False)
def prose_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(text.money_tokens(F.col("text")))).cast("long").alias("amounts"), F.size(F.array_distinct(text.id_tokens(F.col("text")))).cast("long").alias("ids"))
    return d.where("amounts + ids > 0")


@query()
def narration_similarity(spark, sf_dir):
    """Likeness of narrations without a reference to a payout's."""
    b = star_ledgers(spark, sf_dir).bank.where("utr is null").select("narration").distinct()
    return b.select("narration", text.narration_similarity(F.col("narration"), F.lit("UTRX000000000000")).alias("similarity"))


@query()
def membership_subset(spark, sf_dir):
    """Which of a cycle's payments make up its net before refunds, chargebacks aside."""
    l = star_ledgers(spark, sf_dir)
    p = l.payments.where("settlement_id is not null").select("settlement_id", "payment_id", "amount_paise", "fee_paise", "tax_paise")
    s = l.settlements.where("refund_paise = 0 and chargeback_paise = 0").select("settlement_id", F.col("net_paise").alias("credit_paise"))
    return membership.infer_membership(p.join(s, "settlement_id").withColumnRenamed("settlement_id", "bank_row_id"), Rates().withholding_bps).select("bank_row_id", "outcome", "n_solutions")


@query()
def reconcile_star(spark, sf_dir):
    """All tiers over the star ledgers: every order's decision."""
    return reconcile(star_ledgers(spark, sf_dir)).decisions


@query(f"""SELECT s.settlement_id, c.bank_row_id FROM settlements_ s {HI.format(n=3)} JOIN credits_ c ON c.utr = s.utr AND c.credit_paise = s.net_paise AND c.event_date BETWEEN s.event_date AND b.day""")
def stream_exact_pairs(spark, sf_dir):
    """The exact tier's pairs from streams of settlements and credits, drained."""
    l, folder = star_ledgers(spark, sf_dir), f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    s = as_stream(l.settlements.select("settlement_id", "utr", "net_paise", "event_date"), folder)
    c = as_stream(credits_of(l).select("bank_row_id", "utr", "credit_paise", "event_date"), folder)
    return drain(exact_stream(s, c, days(spark)), folder).where("bank_row_id is not null").select("settlement_id", "bank_row_id")


@query(f"""{GATES_SQL} {EXACT_SQL}, d_ AS (SELECT 'orders' AS kind, gate AS reason, NULL AS caused_by FROM gates_ WHERE gate IS NOT NULL
  UNION ALL SELECT 'orders', e.reason, g.settlement_id FROM gates_ g JOIN exact_ e USING (settlement_id) WHERE g.gate IS NULL AND e.reason IS NOT NULL
  UNION ALL SELECT 'settlements', reason, NULL FROM exact_ WHERE reason IS NOT NULL)
  SELECT kind, reason, count(*)::BIGINT AS n, count(*) FILTER (caused_by IS NULL)::BIGINT AS root_causes FROM d_ GROUP BY GROUPING SETS ((kind, reason), (kind), (reason), ())""")
def decline_rollup(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    gates = matching.order_gates(l.orders, l.payments, l.chargebacks).select("settlement_id", "gate")
    exact = matching.exact_settlements(due(spark, l.settlements, 3), credits_of(l)).where("reason is not null").select("settlement_id", "reason")
    none = F.lit(None).cast("string").alias("caused_by")
    parts = [
        gates.where("gate is not null").select(F.lit("orders").alias("kind"), F.col("gate").alias("reason"), none),
        gates.where("gate is null").join(exact, "settlement_id").select(F.lit("orders").alias("kind"), "reason", F.col("settlement_id").alias("caused_by")),
        exact.select(F.lit("settlements").alias("kind"), "reason", none),
    ]
    return exceptions.decline_rollup(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(f"""{GATES_SQL} SELECT g.settlement_id, count(*)::BIGINT AS chains, arg_min(gate, o.ord) FILTER (gate IS NOT NULL) AS first_code
  FROM gates_ g JOIN orders_ o USING (order_id) WHERE g.settlement_id IS NOT NULL GROUP BY 1""")
def first_codes(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    return exceptions.first_codes(matching.order_gates(l.orders, l.payments, l.chargebacks).select("settlement_id", F.col("gate").alias("code"), "ord"))


@query(f"{TOLERANT_SQL} SELECT rule, confidence, count(*)::BIGINT AS n FROM tol_ GROUP BY ALL")
def confidence_histogram(spark, sf_dir):
    return star_tolerant(spark, sf_dir)[1].groupBy("rule", "confidence").agg(F.count("*").alias("n"))


@query(f"""{EXACT_SQL}, v_ AS (SELECT unnest(['NO_BANK_CREDIT_WITH_UTR', 'AMOUNT_MISMATCH', 'OUTSIDE_POSTING_WINDOW', 'AMBIGUOUS_MULTI_CANDIDATE', 'BANK_ROW_ALREADY_CLAIMED']) AS reason)
  SELECT v_.reason, count(e.settlement_id)::BIGINT AS n FROM v_ LEFT JOIN exact_ e ON e.reason = v_.reason GROUP BY 1""")
def reason_coverage(spark, sf_dir):
    """Every reason of the exact tier, also those that never came up."""
    reasons = ("NO_BANK_CREDIT_WITH_UTR", "AMOUNT_MISMATCH", "OUTSIDE_POSTING_WINDOW", "AMBIGUOUS_MULTI_CANDIDATE", "BANK_ROW_ALREADY_CLAIMED")
    return scoring.counts_of(exact_match_staircase(spark, sf_dir), "reason", reasons)


TOLERANCES = (0, 1, 2, 100, 5000, 10_000, 14_000)


@query(f"""SELECT tolerance::BIGINT AS tolerance, coalesce(sum(n), 0)::BIGINT AS candidates, count(settlement_id)::BIGINT AS keys, count(*) FILTER (n > 1)::BIGINT AS ambiguous
  FROM (SELECT unnest({list(TOLERANCES)}) AS tolerance) LEFT JOIN (
    SELECT t, s.settlement_id, count(*) AS n FROM settlements_ s JOIN credits_ c ON c.utr = s.utr, (SELECT unnest({list(TOLERANCES)}) AS t)
    WHERE abs(c.credit_paise - s.net_paise) <= t GROUP BY ALL) ON t = tolerance GROUP BY 1""")
def tolerance_curve(spark, sf_dir):
    l = star_ledgers(spark, sf_dir)
    pairs = l.settlements.select("settlement_id", "utr", "net_paise").join(credits_of(l).select("utr", "credit_paise"), "utr")
    return scoring.tolerance_curve(pairs.withColumn("delta", F.col("credit_paise") - F.col("net_paise")), "settlement_id", "delta", TOLERANCES)
