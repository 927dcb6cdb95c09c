"""Queries of the ledgers' checks, of payouts' arithmetic and of curves over runs, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import scoring
from ledgerloom.plans import queue, validate
from ledgerloom.queries import TOLERANCES, credits_of, query
from ledgerloom.queue_queries import ORACLE_SQL, QUERIES
from ledgerloom.sources.star import star_ledgers

__all__ = ["ORACLE_SQL", "QUERIES"]

RATE_SQL = "CASE method WHEN 'card' THEN 200 WHEN 'netbanking' THEN 180 WHEN 'wallet' THEN 200 ELSE 0 END"
#: Section, check, and the rows that break it.
BROKEN_SQL = [
    *[("identity", f"{t}_unique", f"(SELECT {k} FROM {t}_ GROUP BY 1 HAVING count(*) > 1)") for t, k in validate.KEYS.items()],
    *[("references", f"{t}_{c}", f"{t}_ a WHERE a.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p}_ b WHERE b.{c} = a.{c})") for t, c, p in validate.REFERENCES],
    ("references", "refunded_and_disputed", "(SELECT payment_id FROM refunds_ INTERSECT SELECT payment_id FROM chargebacks_)"),
    ("payments", "batched", "payments_ WHERE settlement_id IS NULL"),
    ("payments", "amount_not_negative", "payments_ WHERE amount_paise < 0"),
    ("payments", "fee_of_method", f"payments_ WHERE fee_paise <> (amount_paise * {RATE_SQL} + 5000) // 10000"),
    ("payments", "tax_of_fee", "payments_ WHERE tax_paise <> (fee_paise * 1800 + 5000) // 10000"),
    ("cycles", "gross_of_members", "c_ WHERE gross_paise <> g"),
    ("cycles", "fee_of_members", "c_ WHERE fee_paise <> f"),
    ("cycles", "tax_of_members", "c_ WHERE tax_paise <> t"),
    ("cycles", "refunds_of_cycle", "c_ WHERE refund_paise <> r"),
    ("cycles", "chargebacks_of_cycle", "c_ WHERE chargeback_paise <> k"),
    ("cycles", "withholding", "c_ WHERE withholding_paise <> (g * 100 + 5000) // 10000"),
    ("cycles", "equation", "c_ WHERE net_paise <> g - f - t - r - k - (g * 100 + 5000) // 10000 + carry_out"),
    ("cycles", "net_not_negative", "c_ WHERE net_paise < 0"),
    ("cycles", "below_gross", "c_ WHERE net_paise > gross_paise"),
    ("cycles", "carried_out_pays_nothing", "c_ WHERE carry_out <> 0 AND net_paise <> 0"),
    ("cycles", "settled_on_business_day", "c_ WHERE isodow(event_date) > 5"),
    *[("dates", f"{t}_after_capture", f"{t}_ a JOIN payments_ p USING (payment_id) WHERE a.event_date < p.event_date") for t in ("refunds", "chargebacks")],
    ("bank", "one_sided", "bank_ WHERE credit_paise <> 0 AND debit_paise <> 0"),
    ("bank", "not_negative", "bank_ WHERE credit_paise < 0 OR debit_paise < 0"),
]
CHECKED_SQL = """c_ AS (SELECT s.*, coalesce(p.g, 0) AS g, coalesce(p.f, 0) AS f, coalesce(p.t, 0) AS t, coalesce(r.x, 0) AS r, coalesce(k.x, 0) AS k FROM settlements_ s
  LEFT JOIN (SELECT settlement_id, sum(amount_paise) AS g, sum(fee_paise) AS f, sum(tax_paise) AS t FROM payments_ GROUP BY 1) p USING (settlement_id)
  LEFT JOIN (SELECT settlement_id, sum(amount_paise) AS x FROM refunds_ GROUP BY 1) r USING (settlement_id) LEFT JOIN (SELECT settlement_id, sum(amount_paise) AS x FROM chargebacks_ GROUP BY 1) k USING (settlement_id)),
checked_ AS (""" + " UNION ALL ".join(f"""SELECT '{s}' AS section, '{c}' AS "check", count(*) = 0 AS passed, count(*)::BIGINT AS failures FROM {rows}""" for s, c, rows in BROKEN_SQL) + ")"


@query(f", {CHECKED_SQL} SELECT * FROM checked_")
def ledger_checks(spark, sf_dir):
    return validate.ledger_checks(star_ledgers(spark, sf_dir))


@query(f""", {CHECKED_SQL} SELECT section, count(*)::BIGINT AS checks, count(*) FILTER (passed)::BIGINT AS passed, sum(failures)::BIGINT AS failures FROM checked_ GROUP BY 1""")
def check_summary(spark, sf_dir):
    return validate.summary(ledger_checks(spark, sf_dir))


@query(""", a_ AS (SELECT settlement_id, 0 AS o, 'payments' AS label, gross_paise AS paise FROM settlements_ UNION ALL SELECT settlement_id, 1, 'fee', -fee_paise FROM settlements_ UNION ALL SELECT settlement_id, 2, 'tax', -tax_paise FROM settlements_
  UNION ALL SELECT settlement_id, 3, 'withholding', -withholding_paise FROM settlements_ UNION ALL SELECT settlement_id, 4, 'refunds', -refund_paise FROM settlements_ WHERE refund_paise <> 0
  UNION ALL SELECT settlement_id, 5, 'chargebacks', -chargeback_paise FROM settlements_ WHERE chargeback_paise <> 0)
  SELECT settlement_id, (row_number() OVER (PARTITION BY settlement_id ORDER BY o) - 1)::INTEGER AS place, label, paise::BIGINT AS paise FROM a_""")
def payout_arithmetic(spark, sf_dir):
    return queue.arithmetic(star_ledgers(spark, sf_dir).settlements)


CURVES_SQL = f""", t_ AS (SELECT unnest({list(TOLERANCES)})::BIGINT AS tolerance), n_ AS (SELECT year(capture_date) AS run, count(*) AS total FROM settlements_ GROUP BY 1),
k_ AS (SELECT year(capture_date) AS run, tolerance, settlement_id, count(*) AS n FROM settlements_ s JOIN credits_ c ON c.utr = s.utr JOIN t_ ON abs(c.credit_paise - s.net_paise) <= tolerance GROUP BY ALL),
p_ AS (SELECT run, tolerance, count(*) AS answered, count(*) FILTER (n > 1) AS wrong FROM k_ GROUP BY ALL),
curves_ AS (SELECT run, tolerance, coalesce(answered, 0) AS answered, coalesce(wrong, 0) AS wrong, (answered - wrong) / answered AS "precision", coalesce(answered, 0) / total AS coverage FROM n_ CROSS JOIN t_ LEFT JOIN p_ USING (run, tolerance))"""


def star_curves(spark, sf_dir):
    """Each year's cycles as a run."""
    l = star_ledgers(spark, sf_dir)
    s = l.settlements.select("settlement_id", "utr", "net_paise", F.year("capture_date").alias("run"))
    pairs = s.join(credits_of(l).select("utr", "credit_paise"), "utr").withColumn("delta", F.col("credit_paise") - F.col("net_paise"))
    return scoring.run_curves(pairs, s.groupBy("run").agg(F.count("*").alias("total")), "run", "settlement_id", "delta", TOLERANCES)


@query(f"""{CURVES_SQL}, b_ AS (SELECT *, first_value(coverage) OVER (PARTITION BY run ORDER BY tolerance) AS base FROM curves_)
  SELECT run::INTEGER AS run, min(tolerance) FILTER ("precision" < 1) AS first_loss, min(tolerance) FILTER (coverage <> base) AS first_coverage_move FROM b_ GROUP BY 1""")
def curve_limits(spark, sf_dir):
    return scoring.curve_limits(star_curves(spark, sf_dir), "run")


GRID_SQL = """SELECT tolerance, min("precision") AS least_precision, avg(coverage) AS mean_coverage, sum(wrong)::BIGINT AS wrong, bool_and(coalesce("precision" = 1, false)) AS exact FROM curves_ GROUP BY 1"""


@query(f"{CURVES_SQL} SELECT tolerance, round(least_precision * 10000)::BIGINT AS least_precision_bps, round(mean_coverage * 10000)::BIGINT AS mean_coverage_bps, wrong, exact FROM ({GRID_SQL})")
def curve_grid(spark, sf_dir):
    bps = lambda c: F.round(F.col(c) * 10000).cast("long").alias(f"{c}_bps")
    return scoring.curve_grid(star_curves(spark, sf_dir)).select("tolerance", bps("least_precision"), bps("mean_coverage"), "wrong", "exact")


@query(f"{CURVES_SQL} SELECT max(tolerance) FILTER (exact) AS exact_through, min(tolerance) FILTER (least_precision < 1) AS earliest_loss FROM ({GRID_SQL})")
def exact_through(spark, sf_dir):
    return scoring.exact_through(scoring.curve_grid(star_curves(spark, sf_dir)))
