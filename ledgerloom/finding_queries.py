"""Queries of identified payouts, unnamed credits, the whole queue and its findings, over the star-schema tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.config import Rates
from ledgerloom.operators import attribution, exceptions, matching, membership, scoring, search
from ledgerloom.operators.identify import identified
from ledgerloom.functions import grounding, money
from ledgerloom.plans import chain, explain, findings, trace, validate, views
from ledgerloom.queries import DECIDED_SQL, EXACT_SQL, GATES_SQL, WIDE, built, credits_of, days, due, net_verdicts, query, star_decided, star_gaps, star_typed
from ledgerloom.queue_queries import LEVELS_SQL, star_levels
from ledgerloom.report_queries import ORACLE_SQL, QUERIES
from ledgerloom.sources import results
from ledgerloom.sources.checkpoints import cut, shared_root
from ledgerloom.sources.star import star_ledgers, table

__all__ = ["ORACLE_SQL", "QUERIES"]

ITEMS_SQL = """, items_ AS (SELECT payment_id AS item_id, 'payment' AS kind, 'L1' AS level, amount_paise - fee_paise - tax_paise - (amount_paise * 100 + 5000) // 10000 AS m, settlement_id AS own FROM payments_
  UNION ALL SELECT item_id, 'refund', 'L2', amount_paise, settlement_id FROM refunds_ UNION ALL SELECT item_id, 'chargeback', 'L3', amount_paise, settlement_id FROM chargebacks_)"""


@query(f"""{ITEMS_SQL}, named_ AS (SELECT utr FROM credits_ WHERE utr IS NOT NULL GROUP BY utr HAVING count(*) = 1),
  gap_ AS (SELECT s.settlement_id, c.bank_row_id, s.net_paise - c.credit_paise AS delta FROM settlements_ s JOIN cal_ k ON k.day = s.event_date JOIN biz_ b ON b.seq = k.start + 3
    JOIN credits_ c ON c.event_date BETWEEN s.event_date AND b.day WHERE s.net_paise > 0 AND s.utr NOT IN (SELECT utr FROM named_) AND abs(s.net_paise - c.credit_paise) > 2),
  fit_ AS (SELECT g.*, i.level, i.kind, i.item_id FROM gap_ g JOIN items_ i ON i.m BETWEEN abs(g.delta) - 2 AND abs(g.delta) + 2 AND i.own IS DISTINCT FROM g.settlement_id),
  one_ AS (SELECT settlement_id, bank_row_id, delta, level, min(kind) AS kind, min(item_id) AS item_id FROM fit_ f WHERE level = (SELECT min(level) FROM fit_ x WHERE x.settlement_id = f.settlement_id AND x.bank_row_id = f.bank_row_id) GROUP BY ALL HAVING count(*) = 1),
  range_ AS (SELECT *, greatest(1, abs(delta) // 2) AS lo, greatest(greatest(1, abs(delta) // 2) + 1, abs(delta) * 3 // 2) AS hi FROM one_),
  chance_ AS (SELECT r.settlement_id, r.bank_row_id, r.delta, r.level, r.item_id, sum(greatest(0, least(hi - 1, m + 2) - greatest(lo, m - 2) + 1)) / min(hi - lo) AS expected
    FROM range_ r JOIN items_ i ON i.kind = r.kind AND i.own IS DISTINCT FROM r.settlement_id GROUP BY ALL)
  SELECT settlement_id, bank_row_id, delta::BIGINT AS delta, level, item_id FROM chance_ WHERE expected < 0.01""")
def identified_payouts(spark, sf_dir):
    """Payouts without a reference that one strong item identifies (pairs of items have tests, and no SQL that ends)."""
    l = star_ledgers(spark, sf_dir)
    named = credits_of(l).where("utr is not null").groupBy("utr").count().where("count = 1").select("utr")
    open_ = due(spark, built(l).join(named, "utr", "left_anti").where("expected_net_paise > 0"), C.NET_WINDOW)
    items = attribution.item_pool(l.payments, l.refunds, l.chargebacks, Rates().withholding_bps)
    found = identified(open_.select("settlement_id", "expected_net_paise", "event_date", "hi"), credits_of(l), items)
    return found.where("level <> 'L4'").select("settlement_id", "bank_row_id", "delta", "level", "item_id")


@query("""SELECT c.bank_row_id, count(*)::BIGINT AS pool_size, sum(p.amount_paise - p.fee_paise - p.tax_paise)::BIGINT AS total FROM credits_ c JOIN (SELECT p.*, b.day AS due, e.day AS until FROM payments_ p
    JOIN cal_ k ON k.day = CASE WHEN hour(p.ts) >= 23 THEN p.ts::DATE + 1 ELSE p.ts::DATE END JOIN biz_ b ON b.seq = k.start + 2 JOIN cal_ d ON d.day = b.day JOIN biz_ e ON e.seq = d.start + 3) p
  ON c.event_date BETWEEN p.due AND p.until AND p.amount_paise - p.fee_paise - p.tax_paise - (p.amount_paise * 100 + 5000) // 10000 <= c.credit_paise + 2 GROUP BY 1""")
def pool_sizes(spark, sf_dir):
    """How many payments each credit may be made of, and their sum, counted without a row for each."""
    l = star_ledgers(spark, sf_dir)
    p = membership.due_payments(l.payments, days(spark), 2, 23, 100)
    d = membership.due_days(credits_of(l), p, days(spark), C.NET_WINDOW, C.NET_TOLERANCE)
    return membership.pool_sizes(d, p).select("bank_row_id", "pool_size", F.col("total").cast("long").alias("total"))


@query()
def credit_memberships(spark, sf_dir):
    """Which payments make up the credits that no reference ties to a payout."""
    l = star_ledgers(spark, sf_dir)
    loose = credits_of(l).join(l.settlements.select("utr"), "utr", "left_anti")
    likeness = F.when(F.startswith("bank_row_id", F.lit("bank_e")), 0.0).otherwise(100.0)
    return membership.memberships(loose, l.payments, days(spark), Rates(holidays=()), likeness).select("bank_row_id", "credit_paise", "outcome", "pool_size", "n_solutions", "expected", "band")


@query()
def subset_reliability(spark, sf_dir):
    """How far answers of a subset search can be trusted, by the size of the pool, and up to which size all were right."""
    curve = cut(membership.reliability(star_ledgers(spark, sf_dir).payments, Rates().withholding_bps))
    return curve.join(F.broadcast(membership.ceiling(curve)))  # one row


QUEUE_SQL = f"""{LEVELS_SQL}{GATES_SQL}, typed2_ AS (SELECT *, CASE gate WHEN 'NO_PAYMENT_FOR_ORDER' THEN 'ORDER_UNPAID' WHEN 'MULTIPLE_PAYMENTS_FOR_ORDER' THEN 'DUPLICATE_PAYMENT'
    WHEN 'ORDER_PAYMENT_AMOUNT_MISMATCH' THEN 'AMOUNT_VARIANCE_UNEXPLAINED' WHEN 'PAYMENT_HAS_CHARGEBACK' THEN 'CHARGEBACK_UNPOSTED' ELSE 'UNKNOWN' END AS code FROM gates_ WHERE gate IS NOT NULL),
  verdict_ AS ({ORACLE_SQL['net_verdicts']}),
  cause_ AS (SELECT split_part(gap_id, '/', 1) AS settlement_id, n, CASE level WHEN 'L1' THEN 'payment' WHEN 'L2' THEN 'refund' ELSE 'chargeback' END AS kind, item_id FROM first_ JOIN verdict_ v ON gap_id = v.settlement_id || '/' || v.bank_row_id),
  own_ AS (SELECT settlement_id, count(*) AS chains FROM gates_ JOIN verdict_ USING (settlement_id) WHERE gate IS NULL AND outcome <> 'MATCHED' GROUP BY 1),
  pay_ AS (SELECT v.outcome || '__' || v.settlement_id AS group_id, 'settlement' AS kind, v.outcome AS code, strftime(s.event_date, '%d %b') || ' – ' || CASE WHEN v.outcome = 'MISSING_IN_BANK' THEN 'payout never arrived' WHEN v.outcome = 'TIMING_PENDING' THEN 'still inside the clearing window'
      WHEN n = 1 THEN CASE c.kind WHEN 'payment' THEN 'payment ' || item_id || ' booked to another cycle' WHEN 'refund' THEN 'refund ' || item_id || ' from an earlier cycle' ELSE 'chargeback ' || item_id || ' not recorded in books' END
      WHEN n > 1 THEN CASE n WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four' WHEN 5 THEN 'five' WHEN 6 THEN 'six' ELSE n::VARCHAR END || ' possible causes, needs gateway breakdown' ELSE 'cause not identified' END AS headline,
      CASE WHEN v.outcome <> 'MISSING_IN_BANK' AND coalesce(variance_paise, 0) <> 0 THEN abs(variance_paise) ELSE s.net_paise END::BIGINT AS rupees_paise, coalesce(chains, 0)::BIGINT AS affected_chains
    FROM verdict_ v JOIN settlements_ s USING (settlement_id) LEFT JOIN cause_ c USING (settlement_id) LEFT JOIN own_ USING (settlement_id) WHERE v.outcome <> 'MATCHED'),
  ord_ AS (SELECT 'tier5__' || code AS group_id, 'orders' AS kind, code, CASE code WHEN 'ORDER_UNPAID' THEN 'Orders with no payment anywhere' WHEN 'DUPLICATE_PAYMENT' THEN 'Orders captured more than once' WHEN 'AMOUNT_VARIANCE_UNEXPLAINED' THEN 'Orders whose value disagrees with the capture'
      WHEN 'CHARGEBACK_UNPOSTED' THEN 'Disputes debited but not recorded' ELSE 'Unknown' END AS headline, sum(amount_paise)::BIGINT AS rupees_paise, count(*)::BIGINT AS affected_chains FROM typed2_ GROUP BY code),
  queue_ AS (SELECT * FROM pay_ UNION ALL SELECT * FROM ord_)"""


def star_queue(spark, sf_dir):
    """The queue's parts over the star tables: verdicts by computed net, single items as causes, orders that a gate stops."""
    l = star_ledgers(spark, sf_dir)
    v = net_verdicts(spark, sf_dir).join(built(l).select("settlement_id", "expected_net_paise"), "settlement_id").withColumn("identified_by", F.lit(None).cast("string"))
    gates = matching.order_gates(l.orders, l.payments, l.chargebacks)
    decided = gates.where("gate is null").join(v.select("settlement_id", "outcome"), "settlement_id")
    first = star_levels(spark, sf_dir)[1]
    told = first.join(v.select(F.concat_ws("/", "settlement_id", "bank_row_id").alias("gap_id"), "settlement_id"), "gap_id")
    one = F.col("n") == 1
    told = told.select("gap_id", "settlement_id", "level", F.when(one, "ATTRIBUTED").otherwise("AMBIGUOUS_MULTI_CANDIDATE").alias("outcome"), "item_id", F.col("n").alias("n_candidates"), F.lit(None).cast("string").alias("band"), F.lit(None).cast("double").alias("expected"))
    none = spark.createDataFrame([], "settlement_id string, bank_row_id string, level string, item_id string, expected double")
    pay = findings.payout_findings(v, l.settlements, decided, told, none)
    return pay.unionByName(findings.order_findings(exceptions.groups(star_typed(spark, sf_dir))))


SHOWN_QUEUE = ("place", "group_id", "kind", "code", "headline", "rupees_paise", "affected_chains")


@query(f"{QUEUE_SQL} SELECT row_number() OVER (ORDER BY rupees_paise DESC, group_id)::BIGINT AS place, * FROM queue_")
def finding_queue(spark, sf_dir):
    """Payouts and kinds of orders in one queue, with cause and exposure, dearest first."""
    from ledgerloom.operators.ranking import numbered

    return numbered(star_queue(spark, sf_dir), [F.desc("rupees_paise"), F.asc("group_id")], "place")[0].select(*SHOWN_QUEUE)


@query(f"""{ITEMS_SQL}, gap_ AS (SELECT settlement_id || '/' || bank_row_id AS gap_id, settlement_id, abs(net_paise - credit_paise) AS t FROM settlements_ s JOIN credits_ c USING (utr) WHERE abs(net_paise - credit_paise) > 500),
  fit_ AS (SELECT gap_id, level, item_id, kind, t - m AS residual FROM gap_ g JOIN items_ i ON i.m BETWEEN t - 500 AND t + 500 AND i.own IS DISTINCT FROM g.settlement_id),
  best_ AS (SELECT * FROM fit_ f WHERE level = (SELECT min(level) FROM fit_ x WHERE x.gap_id = f.gap_id) QUALIFY row_number() OVER (PARTITION BY gap_id ORDER BY abs(residual), item_id) <= 6)
  SELECT gap_id, min(level) AS level, string_agg(item_id || ' ' || residual, ', ' ORDER BY abs(residual), item_id) AS candidates FROM best_ GROUP BY gap_id""")
def finding_candidates(spark, sf_dir):
    """The first six candidates of each gap within five rupees; no two items are that small, so there are no pairs."""
    l = star_ledgers(spark, sf_dir)
    items = attribution.item_pool(l.payments, l.refunds, l.chargebacks, Rates().withholding_bps)
    gaps = l.settlements.join(credits_of(l).select("utr", "bank_row_id", "credit_paise"), "utr").select(F.concat_ws("/", "settlement_id", "bank_row_id").alias("gap_id"), "settlement_id", (F.col("net_paise") - F.col("credit_paise")).alias("delta"))
    c = attribution.shown_candidates(gaps, items, 500)
    return c.select("gap_id", "level", F.array_join(F.transform("candidates", lambda x: F.concat_ws(" ", x["item_id"], x["residual"])), ", ").alias("candidates"))


@query("""SELECT k % 10 AS digit, count(*)::BIGINT AS answers, count(*) FILTER (NOT (k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0))::BIGINT AS ok, count(*) FILTER (k % 11 = 0 OR k % 17 = 0)::BIGINT AS unknown_ids,
  count(*) FILTER (k % 17 = 0)::BIGINT AS unknown_codes, count(*) FILTER (k % 13 = 0)::BIGINT AS guesses, count(*) FILTER (k % 19 = 0)::BIGINT AS timing FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1""", star=False)
def grounded_answers(spark, sf_dir):
    """Sentences about orders against JSON of their rows; by the key's remainders, figures, ids, codes, causes and claims are made up."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), money.from_float(F.col("o_totalprice")).alias("paise"))
    every = lambda n: F.col("k") % n == 0
    amount = money.format_inr(F.col("paise") + F.when(every(7), 7_000_000_001_01).otherwise(0))
    row = F.to_json(F.named_struct(F.lit("order"), F.struct(F.concat(F.lit("ord_"), "k").alias("id"), money.format_inr(F.col("paise")).alias("amount")), F.lit("steps"), F.array(F.named_struct(F.lit("reason"), F.lit("ORDER_UNPAID")))))
    result = F.when(every(17), F.to_json(F.named_struct(F.lit("error"), F.concat(F.lit("no decision recorded for ord_"), "k")))).otherwise(row)
    answer = F.concat(
        F.lit("Order ord_"), F.when(every(11), F.concat("k", F.lit("x"))).otherwise(F.col("k").cast("string")), F.lit(" over "), amount, F.lit(" is ORDER_UNPAID."),
        F.when(every(13), " It probably slipped.").otherwise(""), F.when(every(19), " Losses cluster at month end.").otherwise(""),
    )
    v = o.select("k", grounding.grounded(answer, F.array(F.lit("get_entity")), F.array(result)).alias("v"))
    some = lambda c: F.count_if(F.size(f"v.{c}") > 0)
    return v.groupBy((F.col("k") % 10).alias("digit")).agg(F.count("*").alias("answers"), F.count_if("v.ok").alias("ok"), some("ids_unverified").alias("unknown_ids"), some("codes_unverified").alias("unknown_codes"), some("speculative").alias("guesses"), some("claims").alias("timing"))


H = {k: v.replace("'", "''") for k, v in chain.HOW.items()}


@query(f""", edge_ AS (SELECT 'payments' AS src, payment_id AS a, 'orders' AS dst, order_id AS b, 'up' AS way, '' AS how FROM payments_ UNION ALL SELECT 'refunds', item_id, 'payments', payment_id, 'up', '' FROM refunds_ UNION ALL SELECT 'chargebacks', item_id, 'payments', payment_id, 'up', '' FROM chargebacks_
    UNION ALL SELECT 'orders', order_id, 'payments', payment_id, 'down', '{H["payment"]}' FROM payments_ UNION ALL SELECT 'payments', payment_id, 'refunds', item_id, 'down', '{H["refund"]}' FROM refunds_ UNION ALL SELECT 'payments', payment_id, 'chargebacks', item_id, 'down', '{H["chargeback"]}' FROM chargebacks_
    UNION ALL SELECT 'payments', payment_id, 'settlements', settlement_id, 'down', '{H["payout"]}' FROM payments_ JOIN settlements_ USING (settlement_id)),
  root_ AS (SELECT 'orders' AS t, order_id AS id FROM orders_ UNION ALL SELECT 'payments', payment_id FROM payments_ UNION ALL SELECT 'refunds', item_id FROM refunds_ UNION ALL SELECT 'chargebacks', item_id FROM chargebacks_),
  hold_ AS (SELECT s.settlement_id, b.bank_row_id FROM settlements_ s JOIN (SELECT bank_row_id, unnest(regexp_extract_all(upper(narration), 'UTRX[0-9]{{12}}')) AS u FROM bank_) b ON b.u = s.utr),
  hop_ AS (SELECT s.settlement_id, CASE WHEN count(h.bank_row_id) = 1 THEN min(h.bank_row_id) END AS b, CASE count(h.bank_row_id) WHEN 0 THEN '{H["none"]}' WHEN 1 THEN '{H["bank"]}' ELSE '{H["many"]}' END AS how FROM settlements_ s LEFT JOIN hold_ h USING (settlement_id) GROUP BY 1),
  walk_ AS (WITH RECURSIVE w AS (SELECT t AS root_table, id AS root_id, t AS tab, id AS cur, CASE WHEN t = 'orders' THEN 'down' ELSE 'up' END AS way, '{H["order"]}' AS how FROM root_
    UNION SELECT w.root_table, w.root_id, e.dst, e.b, CASE WHEN e.dst = 'orders' THEN 'down' ELSE w.way END, CASE WHEN e.dst = 'orders' THEN '{H["order"]}' ELSE e.how END FROM w JOIN edge_ e ON e.src = w.tab AND e.a = w.cur AND e.way = w.way) SELECT * FROM w WHERE way = 'down'),
  down_ AS (SELECT w.root_table, w.root_id, w.tab, w.cur, w.how FROM walk_ w WHERE tab <> 'orders' OR cur IN (SELECT order_id FROM orders_)
    UNION ALL SELECT w.root_table, w.root_id, 'bank', h.b, h.how FROM walk_ w JOIN hop_ h ON w.tab = 'settlements' AND h.settlement_id = w.cur),
  n_ AS (SELECT s.settlement_id, count(p.payment_id) AS np, count(DISTINCT p.order_id) AS no FROM settlements_ s LEFT JOIN payments_ p USING (settlement_id) GROUP BY 1),
  side_ AS (SELECT 'settlements' AS root_table, settlement_id AS root_id, settlement_id FROM settlements_ UNION ALL SELECT 'bank', bank_row_id, min(settlement_id) FROM hold_ GROUP BY 2),
  all_ AS (SELECT root_table, root_id, tab, how, 0 AS n FROM down_ UNION ALL SELECT root_table, root_id, 'settlements', '{H["own_payout"]}', 0 FROM side_
    UNION ALL SELECT root_table, root_id, 'bank', how, 0 FROM side_ JOIN hop_ USING (settlement_id) WHERE root_table = 'settlements' UNION ALL SELECT root_table, root_id, 'bank', '{H["bank"]}', 0 FROM side_ WHERE root_table = 'bank'
    UNION ALL SELECT root_table, root_id, 'payments', '{H["members"]}', np FROM side_ JOIN n_ USING (settlement_id) UNION ALL SELECT root_table, root_id, 'orders', '{H["behind"]}', no FROM side_ JOIN n_ USING (settlement_id)
    UNION ALL SELECT 'bank', bank_row_id, x.t, x.how, 0 FROM bank_, (VALUES ('bank', '{H["own_bank"]}'), ('settlements', '{H["unnamed"]}')) x(t, how) WHERE bank_row_id NOT IN (SELECT bank_row_id FROM hold_))
  SELECT root_table, tab AS "table", how, count(*)::BIGINT AS hops, count(DISTINCT root_id)::BIGINT AS roots, sum(n)::BIGINT AS inside FROM all_ GROUP BY ALL""")
def chain_links(spark, sf_dir):
    """From every row of all six ledgers to the same money in the others: hops by kind of row and how they were made."""
    l = star_ledgers(spark, sf_dir)
    return chain.links(l, chain.every_row(l)).groupBy("root_table", "table", "how").agg(F.count("*").alias("hops"), F.countDistinct("root_id").alias("roots"), F.sum(F.coalesce("n", F.lit(0))).alias("inside"))


@query(f"""{GATES_SQL}{EXACT_SQL},
  told_ AS (SELECT order_id AS entity_id, gate AS reason, amount_paise AS a FROM gates_ WHERE gate IS NOT NULL UNION ALL SELECT e.settlement_id, reason, net_paise FROM exact_ e JOIN settlements_ USING (settlement_id) WHERE reason IS NOT NULL)
  SELECT reason, count(*)::BIGINT AS n, count(DISTINCT entity_id)::BIGINT AS entities, sum(a)::BIGINT AS paise FROM told_ GROUP BY 1""")
def decline_traces(spark, sf_dir):
    """Traces of the exact tier: how often each reason is told, in a sentence about the row's own money."""
    l = star_ledgers(spark, sf_dir)
    g = matching.order_gates(l.orders, l.payments, l.chargebacks)
    e = matching.exact_settlements(due(spark, l.settlements, C.EXACT_WINDOW), credits_of(l))
    one = lambda df, id_, kind, reason: df.where(F.col(reason).isNotNull()).select(F.lit(1).alias("tier"), F.col(id_).alias("entity_id"), F.lit(kind).alias("kind"), F.col(reason).alias("reason"), F.lit(None).cast("string").alias("caused_by"))
    told = one(g, "order_id", "orders", "gate").unionByName(one(e, "settlement_id", "settlements", "reason"))
    none = spark.createDataFrame([], "order_id string, outcome string, settlement_id string, tier int")
    t = trace.traces(l, told, none, spark.createDataFrame([], "bank_row_id string, disposition string"))
    steps = t.select("entity_id", "source", F.explode("steps").alias("s")).where("s.sentence is not null and not contains(s.sentence, '{')")
    return steps.join(trace.own_rows(l).select("entity_id", "source", "amount_paise"), ["entity_id", "source"]).groupBy("s.reason").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"), F.sum("amount_paise").alias("paise"))


@query("""SELECT settlement_id, source, count(*)::BIGINT AS n, sum(a)::BIGINT AS paise FROM (SELECT DISTINCT settlement_id, 'orders' AS source, order_id AS id, o.amount_paise AS a FROM payments_ p JOIN orders_ o USING (order_id) WHERE settlement_id IS NOT NULL
  UNION ALL SELECT settlement_id, 'payments', payment_id, amount_paise FROM payments_ WHERE settlement_id IS NOT NULL UNION ALL SELECT settlement_id, 'refunds', item_id, amount_paise FROM refunds_ UNION ALL SELECT settlement_id, 'chargebacks', item_id, amount_paise FROM chargebacks_) GROUP BY ALL""")
def payout_rows(spark, sf_dir):
    """What lies inside each payout, by ledger."""
    return views.payout_rows(star_ledgers(spark, sf_dir)).groupBy("settlement_id", "source").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("paise"))


@query(f"{DECIDED_SQL} SELECT count(*)::BIGINT AS orders, count(*) FILTER (outcome = 'MATCHED')::BIGINT AS matched, count(*) FILTER (outcome <> 'MATCHED')::BIGINT AS exceptions, count(*) FILTER (outcome = 'MATCHED') / count(*) AS coverage FROM said_")
def run_summary(spark, sf_dir):
    return views.run_summary(star_decided(spark, sf_dir)[0])


#: Rules about days and order, and what breaks them.
SEQUENCE_SQL = [
    ("cycles", "settles_when_due", "settlements_ s LEFT JOIN cal_ k ON k.day = s.capture_date LEFT JOIN biz_ b ON b.seq = k.start + 2 WHERE s.event_date IS DISTINCT FROM b.day"),
    ("cycles", "settles_on_a_business_day", "settlements_ WHERE event_date NOT IN (SELECT day FROM biz_)"),
    ("cycles", "carry_goes_on", "(SELECT 0 AS i, lag(carry_out) OVER (ORDER BY capture_date, ord, settlement_id) AS o FROM settlements_) WHERE i <> o"),
    ("cycles", "first_carries_nothing_in", "settlements_ WHERE false"),
    ("payments", "method_has_a_rate", "payments_ WHERE method NOT IN ('card', 'netbanking', 'wallet', 'upi')"),
    ("payments", "free_method_is_free", "payments_ WHERE method = 'upi' AND fee_paise <> 0"),
    ("payments", "in_its_days_cycle", "payments_ p JOIN settlements_ s USING (settlement_id) WHERE CASE WHEN hour(p.ts) >= 23 THEN p.ts::DATE + 1 ELSE p.ts::DATE END <> s.capture_date"),
    ("dates", "refunds_in_the_next_cycle", "refunds_ r JOIN settlements_ s USING (settlement_id) WHERE s.event_date IS DISTINCT FROM (SELECT min(event_date) FROM settlements_ x WHERE x.event_date >= r.event_date)"),
    ("dates", "chargebacks_in_the_next_cycle", "chargebacks_ r JOIN settlements_ s USING (settlement_id) WHERE s.event_date IS DISTINCT FROM (SELECT min(event_date) FROM settlements_ x WHERE x.event_date >= r.event_date)"),
    ("bank", "in_order_of_days", "(SELECT event_date, lag(event_date) OVER (ORDER BY n) AS b FROM (SELECT event_date, CASE WHEN starts_with(bank_row_id, 'bank_e') THEN substr(bank_row_id, 7)::BIGINT + 1000000000000000 ELSE regexp_extract(bank_row_id, '\\d+')::BIGINT END AS n FROM bank_)) WHERE event_date < b"),
]


@query(" UNION ALL ".join(f"SELECT '{a}' AS section, '{b}' AS \"check\", count(*) = 0 AS passed, count(*)::BIGINT AS failures FROM {q}" for a, b, q in SEQUENCE_SQL))
def sequence_checks(spark, sf_dir):
    """Rules about days and order over the star ledgers, which keep some of them and break others."""
    l = star_ledgers(spark, sf_dir)
    return validate.sequence_checks(l, days(spark), Rates(holidays=()))


DECIDED_QUEUE_SQL = f"{QUEUE_SQL} SELECT count(*)::BIGINT AS findings, count(*) FILTER (rupees_paise % 3 = 0)::BIGINT AS decided, count(*) FILTER (rupees_paise % 3 <> 0)::BIGINT AS open, coalesce(sum(rupees_paise) FILTER (rupees_paise % 3 <> 0), 0)::BIGINT AS open_paise FROM queue_"


@query(DECIDED_QUEUE_SQL)
def decided_queue(spark, sf_dir):
    """What is left of the queue after two batches of decisions, the second of them written twice."""
    q = cut(star_queue(spark, sf_dir).select("group_id", "rupees_paise"))
    log = f"{shared_root(spark)}/decisions-{uuid.uuid4().hex}"
    r = F.col("rupees_paise") % 3
    said = q.where(r < 2).select("group_id", F.when(r == 1, "escalate").when(F.col("rupees_paise") % 2 == 0, "approve").otherwise("reject").alias("action"), F.lit(None).cast("string").alias("note"), F.lit("2026-08-01").alias("at"))
    first = said.withColumn("action", F.lit("escalate"))
    results.append_decisions(log, first, q, "first")
    for _ in range(2):
        results.append_decisions(log, said.withColumn("at", F.lit("2026-08-02")), q, "second")
    return results.remaining(q, results.decision_log(spark, log))


@query(f"""{DECIDED_SQL}, p_ AS (SELECT order_id, count(*) AS n, min(payment_id) AS p FROM payments_ GROUP BY 1)
  SELECT s.outcome, t.expected, count(*)::BIGINT AS n, count(*) FILTER (s.outcome = 'MATCHED' AND ord % 4 = 0)::BIGINT AS wrong_payments FROM said_ s JOIN truth_ t USING (order_id) JOIN orders_ USING (order_id) GROUP BY ALL""")
def document_scores(spark, sf_dir):
    """Decisions written as a result document and read again, against a truth that names another payment for every fourth order."""
    said, truth = star_decided(spark, sf_dir)
    l = star_ledgers(spark, sf_dir)
    paid = l.payments.groupBy("order_id").agg(F.min("payment_id").alias("payment_id"))
    d = said.join(paid, "order_id", "left").withColumn("payment_id", F.when(F.col("outcome") == "MATCHED", F.col("payment_id"))).select("order_id", "outcome", "payment_id", *[F.lit(None).cast("string").alias(c) for c in ("settlement_id", "bank_row_id")])
    folder = f"{shared_root(spark)}/documents-{uuid.uuid4().hex}"
    results.write_result(d, f"{folder}/result")
    other = F.when(F.col("ord") % 4 == 0, F.lit("none")).otherwise(F.col("payment_id"))
    t = truth.join(paid, "order_id", "left").join(l.orders.select("order_id", "ord"), "order_id").select("order_id", F.col("expected").alias("expected_outcome"), F.array(other).alias("payment_ids"))
    t.write.json(f"{folder}/truth")
    told, _, _ = results.read_result(spark, f"{folder}/result", lines=True)
    known, _ = results.read_truth(spark, f"{folder}/truth", lines=True)
    return results.linked(told, known).groupBy("outcome", "expected").agg(F.count("*").alias("n"), F.count_if(F.array_contains("errors", "wrong_payments")).alias("wrong_payments"))


ASKED = ("razorpay", "UTRX00000", "neft-view", "/PAYOUT", "zz", "L-UTR")


@query(f"SELECT w AS wanted, count(*)::BIGINT AS found, min(bank_row_id) AS first_id, max(bank_row_id) AS last_id FROM bank_, (SELECT unnest({list(ASKED)}) AS w) WHERE contains(lower(narration), lower(w)) GROUP BY 1")
def narration_search(spark, sf_dir):
    """Bank rows by parts of their narrations, through postings."""
    b = star_ledgers(spark, sf_dir).bank.select("bank_row_id", "narration")
    wanted = spark.createDataFrame([(w,) for w in ASKED], "wanted string")
    found = search.search(b, search.postings(b, "bank_row_id", "narration"), "bank_row_id", "narration", wanted)
    return found.groupBy("wanted").agg(F.count("*").alias("found"), F.min("bank_row_id").alias("first_id"), F.max("bank_row_id").alias("last_id"))


@query(f"""{LEVELS_SQL}, c_ AS (SELECT gap_id, CASE level WHEN 'L1' THEN 'CIRCUMSTANTIAL' ELSE 'STRONG' END AS band, item_id, (SELECT min(f.item_id) FROM fit_ f WHERE f.gap_id = first_.gap_id AND f.level <> 'L2') AS item FROM first_)
  SELECT band, count(*)::BIGINT AS claims, count(*) FILTER (item_id = item)::BIGINT AS "right", count(*) FILTER (item_id IS DISTINCT FROM item)::BIGINT AS wrong, count(*) FILTER (item_id = item) / count(*) AS accuracy,
    CASE WHEN band = 'STRONG' THEN count(*) FILTER (item_id = item) / count(*) >= 0.98 END AS honest FROM c_ GROUP BY band""")
def band_calibration(spark, sf_dir):
    """Claimed causes, by supplier as runs, against a truth that has no refunds; the exact intervals are tested against tails of the binomial."""
    gaps, items = star_gaps(spark, sf_dir)
    first = star_levels(spark, sf_dir)[1].join(gaps.select("gap_id", F.col("supp").alias("run")), "gap_id")
    said = first.select("run", F.col("gap_id").alias("settlement_id"), "item_id", F.when(F.col("level") == "L1", "CIRCUMSTANTIAL").otherwise("STRONG").alias("band"))
    fits = attribution.single_candidates(gaps, items, WIDE, ["supp"]).where("level <> 'L2'").groupBy("gap_id").agg(F.array(F.min("item_id")).alias("items"))
    truth = fits.join(gaps.select("gap_id", F.col("supp").alias("run")), "gap_id").withColumnRenamed("gap_id", "settlement_id")
    return scoring.calibration(said, truth).drop("low", "high")


@query(f"""{QUEUE_SQL} SELECT q.code, count(*)::BIGINT AS findings, count(*)::BIGINT AS grounded, count(*) FILTER (q.kind = 'settlement' AND c.n = 1 AND q.code = 'AMOUNT_VARIANCE_UNEXPLAINED')::BIGINT AS with_caveat
  FROM queue_ q LEFT JOIN cause_ c ON q.group_id = q.code || '__' || c.settlement_id GROUP BY q.code""")
def finding_prose(spark, sf_dir):
    """Prose of every finding: how much of it says nothing but the finding's own, and how often a cause is named with its caveat."""
    told = explain.checked_prose(explain.explain_findings(star_queue(spark, sf_dir)))
    return told.groupBy("code").agg(F.count("*").alias("findings"), F.count_if("check.ok").alias("grounded"), F.count_if(F.contains("prose", F.lit(explain.CAVEAT))).alias("with_caveat"))


@query(f"""{QUEUE_SQL}, d_ AS (SELECT 'kind' AS dimension, kind AS value, rupees_paise AS a FROM queue_ UNION ALL SELECT 'code', code, rupees_paise FROM queue_ UNION ALL SELECT 'evidence_band', 'none', rupees_paise FROM queue_ UNION ALL SELECT 'identified_by', 'none', rupees_paise FROM queue_)
  SELECT dimension, value, count(*)::BIGINT AS findings, sum(a)::BIGINT AS paise, sum(a) / sum(sum(a)) OVER (PARTITION BY dimension) AS share FROM d_ GROUP BY dimension, value""")
def queue_shares(spark, sf_dir):
    """The queue's money by kind, by code, by band and by how payouts were identified."""
    return findings.queue_breakdown(star_queue(spark, sf_dir))


COMPARED = ("tier5__ORDER_UNPAID", "tier5__DUPLICATE_PAYMENT", "tier5__UNKNOWN")


@query(f"""{QUEUE_SQL} SELECT group_id, rupees_paise, affected_chains, (SELECT count(*) FROM queue_ x WHERE x.code = q.code)::BIGINT AS total_with_this_code, rupees_paise / (SELECT sum(rupees_paise) FROM queue_) AS share_of_queue FROM queue_ q WHERE group_id IN {COMPARED}""")
def compared_findings(spark, sf_dir):
    """Findings side by side, each with how many there are of its code and its share of the queue."""
    return findings.compared(cut(star_queue(spark, sf_dir)), list(COMPARED)).select("group_id", "rupees_paise", "affected_chains", "total_with_this_code", "share_of_queue")


@query("""SELECT source, label, count(*)::BIGINT AS n, count(DISTINCT value)::BIGINT AS "values" FROM (SELECT 'orders' AS source, 'date' AS label, event_date::VARCHAR AS value FROM orders_ UNION ALL SELECT 'payments', 'date', event_date::VARCHAR FROM payments_ UNION ALL SELECT 'settlements', 'date', event_date::VARCHAR FROM settlements_
    UNION ALL SELECT 'bank', 'date', event_date::VARCHAR FROM bank_ UNION ALL SELECT 'orders', 'amount', amount_paise::VARCHAR FROM orders_ UNION ALL SELECT 'payments', 'amount', amount_paise::VARCHAR FROM payments_ UNION ALL SELECT 'settlements', 'amount', net_paise::VARCHAR FROM settlements_
    UNION ALL SELECT 'bank', 'amount', (credit_paise - debit_paise)::VARCHAR FROM bank_ UNION ALL SELECT 'settlements', 'utr', utr FROM settlements_ UNION ALL SELECT 'bank', 'utr', utr FROM bank_ UNION ALL SELECT 'bank', 'narration', narration FROM bank_) WHERE value IS NOT NULL GROUP BY 1, 2""")
def entity_facts(spark, sf_dir):
    """What every row says of itself, fact by fact."""
    return trace.entity_facts(star_ledgers(spark, sf_dir)).groupBy("source", "label").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values"))
