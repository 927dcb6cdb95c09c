"""The ledgers that the star-schema tables stand for, and the same as SQL.

Orders are merchant orders, first and some second lines their captures, returned lines refunds and chargebacks; a
supplier's month is a settlement cycle. The bank statement is derived from the cycles, with rows left out, short,
late, clipped or twice by the remainders of the cycle's number, and from the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import Rates
from ledgerloom.functions.money import apply_bps, from_float
from ledgerloom.functions.text import extract_utr
from ledgerloom.operators.batches import with_fees
from ledgerloom.sources.ledgers import Ledgers, entry_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("_", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]))


def star_ledgers(spark: SparkSession, sf_dir: str) -> Ledgers:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    orders = o.select(_id("ord_", "o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("event_date"), from_float(F.col("o_totalprice")).alias("amount_paise"), F.col("o_orderkey").alias("ord"))
    lines = l.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag").groupBy("l_orderkey", "l_linenumber")
    lines = lines.agg(F.min("l_suppkey").alias("supp"), F.min("l_shipdate").alias("ts"), F.max("l_extendedprice").alias("price"), F.min("l_returnflag").alias("flag"))
    lines = lines.withColumn("day", F.to_date("ts")).withColumn("month", F.year("day") * 100 + F.month("day"))
    sid = _id("setl_", "supp", "month")
    paid = lines.where("l_linenumber = 1 or (l_linenumber = 2 and l_orderkey % 10 = 0)").join(o.select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    amount = from_float(F.when((F.col("l_orderkey") % 7 == 0) | F.col("o_totalprice").isNull(), F.col("price")).otherwise(F.col("o_totalprice")))
    method = F.element_at(F.array(*[F.lit(m) for m in ("card", "netbanking", "wallet", "upi")]), (F.col("l_orderkey") % 4 + 1).cast("int"))
    payments = paid.select(_id("pay_", "l_orderkey", "l_linenumber").alias("payment_id"), _id("ord_", "l_orderkey").alias("order_id"), F.when(F.col("l_orderkey") % 23 != 0, sid).alias("settlement_id"), "ts", F.col("day").alias("event_date"), method.alias("method"), amount.alias("amount_paise"), "supp", "month")
    payments = with_fees(payments, Rates()).withColumnsRenamed({"own_fee": "fee_paise", "own_tax": "tax_paise"})
    back = lambda where, part, prefix: lines.where(where).select(_id(prefix, "l_orderkey", "l_linenumber").alias("item_id"), _id("pay_", "l_orderkey", F.lit("1")).alias("payment_id"), sid.alias("settlement_id"), F.col("day").alias("event_date"), (from_float(F.col("price")) / part).cast("long").alias("amount_paise"), "supp")
    refunds = back("l_linenumber = 3 and flag = 'R'", 10, "rfnd_")
    chargebacks = back("l_linenumber = 4 and flag = 'A' and l_orderkey % 3 = 0", 20, "cb_")
    s = payments.where("settlement_id is not null").groupBy("settlement_id", "supp", "month").agg(F.sum("amount_paise").alias("gross_paise"), F.sum("fee_paise").alias("fee_paise"), F.sum("tax_paise").alias("tax_paise"))
    less = lambda df, out: df.groupBy("settlement_id").agg(F.sum("amount_paise").alias(out))
    s = s.join(less(refunds, "refund_paise"), "settlement_id", "left").join(less(chargebacks, "chargeback_paise"), "settlement_id", "left").fillna(0, ["refund_paise", "chargeback_paise"])
    s = s.withColumn("withholding_paise", apply_bps(F.col("gross_paise"), Rates().withholding_bps))
    raw = F.col("gross_paise") - F.col("fee_paise") - F.col("tax_paise") - F.col("withholding_paise") - F.col("refund_paise") - F.col("chargeback_paise")
    number = (F.col("supp") * 1000000 + F.col("month")).cast("long")
    first = F.make_date(F.floor(F.col("month") / 100).cast("int"), (F.col("month") % 100).cast("int"), F.lit(1))
    s = s.withColumns({"raw": raw, "ord": number, "capture_date": first, "event_date": F.last_day(first), "utr": F.concat(F.lit("UTRX"), F.lpad(number.cast("string"), 12, "0")), "carry_forward_in_paise": F.lit(0).cast("long")})
    settlements = s.withColumns({"net_paise": F.greatest("raw", F.lit(0)), "carry_forward_out_paise": F.greatest(-F.col("raw"), F.lit(0))}).drop("raw")
    credit = F.when(F.col("net_paise") == 0, 0).otherwise(F.col("net_paise") - F.when(F.col("ord") % 11 == 0, 1).otherwise(0) - F.when(F.col("ord") % 13 == 0, 5000).otherwise(0))
    posted = F.date_add("event_date", F.when(F.col("ord") % 7 == 0, 9).otherwise(1).cast("int"))
    clip = F.substring(F.concat(F.lit("NEFT CR-RATN0000088-RAZORPAY SOFTWARE PVT LTD-"), "utr"), 1, 35)
    narration = F.when(F.col("ord") % 5 == 0, clip).otherwise(F.concat(F.lit("IMPS/"), "utr", F.lit("/RAZORPAY SOFTWARE/PAYOUT")))
    twice = F.explode(F.when(F.col("ord") % 19 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    cycles = settlements.where("ord % 17 <> 0").withColumn("copy", twice).select(F.concat(F.lit("bank_"), F.col("ord").cast("string"), "copy").alias("bank_row_id"), posted.alias("event_date"), narration.alias("narration"), F.greatest(credit, F.lit(0)).alias("credit_paise"), F.lit(0).cast("long").alias("debit_paise"), "ord")
    e = table(spark, sf_dir, "events")
    paise = from_float(F.col("value"))
    noise = e.select(_id("bank_e", "event_id").alias("bank_row_id"), F.to_date("ts").alias("event_date"), F.concat(F.lit("NEFT-"), "event_type").alias("narration"), F.when(F.col("event_id") % 2 == 0, paise).otherwise(0).alias("credit_paise"), F.when(F.col("event_id") % 2 == 1, paise).otherwise(0).alias("debit_paise"), (F.col("event_id") + 10**15).alias("ord"))
    bank = cycles.unionByName(noise)
    bank = bank.withColumns({"utr": extract_utr(F.col("narration")), "entry_type": entry_type(F.col("credit_paise"))})
    return Ledgers(orders, payments, refunds, chargebacks, settlements, bank)


def _bps(x: str, bps: str) -> str:
    return f"(({x}) * ({bps}) + 5000) // 10000"


#: The same tables in SQL: orders_, payments_, refunds_, chargebacks_, settlements_, bank_, and business days cal_.
STAR_SQL = f"""
orders_ AS (SELECT 'ord_' || o_orderkey AS order_id, o_orderdate::DATE AS event_date, round(o_totalprice * 100)::BIGINT AS amount_paise, o_orderkey AS ord FROM orders),
lines_ AS (
  SELECT *, year(day) * 100 + month(day) AS mon FROM (
    SELECT l_orderkey, l_linenumber, min(l_suppkey) AS supp, min(l_shipdate) AS ts, min(l_shipdate)::DATE AS day, max(l_extendedprice) AS price, min(l_returnflag) AS flag
    FROM lineitem GROUP BY l_orderkey, l_linenumber)),
paid_ AS (
  SELECT 'pay_' || l_orderkey || '_' || l_linenumber AS payment_id, 'ord_' || l_orderkey AS order_id, CASE WHEN l_orderkey % 23 <> 0 THEN 'setl_' || supp || '_' || mon END AS settlement_id,
    ts, day AS event_date, ['card', 'netbanking', 'wallet', 'upi'][l_orderkey % 4 + 1] AS method, [200, 180, 200, 0][l_orderkey % 4 + 1] AS bps,
    round(CASE WHEN l_orderkey % 7 = 0 OR o_totalprice IS NULL THEN price ELSE o_totalprice END * 100)::BIGINT AS amount_paise, supp, mon
  FROM lines_ LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 OR (l_linenumber = 2 AND l_orderkey % 10 = 0)),
fees_ AS (SELECT *, {_bps("amount_paise", "bps")} AS fee_paise FROM paid_),
payments_ AS (SELECT *, {_bps("fee_paise", "1800")} AS tax_paise FROM fees_),
refunds_ AS (SELECT 'rfnd_' || l_orderkey || '_' || l_linenumber AS item_id, 'pay_' || l_orderkey || '_1' AS payment_id, 'setl_' || supp || '_' || mon AS settlement_id, day AS event_date, round(price * 100)::BIGINT // 10 AS amount_paise, supp FROM lines_ WHERE l_linenumber = 3 AND flag = 'R'),
chargebacks_ AS (SELECT 'cb_' || l_orderkey || '_' || l_linenumber AS item_id, 'pay_' || l_orderkey || '_1' AS payment_id, 'setl_' || supp || '_' || mon AS settlement_id, day AS event_date, round(price * 100)::BIGINT // 20 AS amount_paise, supp FROM lines_ WHERE l_linenumber = 4 AND flag = 'A' AND l_orderkey % 3 = 0),
gross_ AS (SELECT settlement_id, supp, mon, count(*) AS n_payments, sum(amount_paise)::BIGINT AS gross_paise, sum(fee_paise)::BIGINT AS fee_paise, sum(tax_paise)::BIGINT AS tax_paise FROM payments_ WHERE settlement_id IS NOT NULL GROUP BY ALL),
less_ AS (
  SELECT g.*, coalesce(r.x, 0)::BIGINT AS refund_paise, coalesce(c.x, 0)::BIGINT AS chargeback_paise, {_bps("gross_paise", "100")} AS withholding_paise, supp * 1000000 + mon AS ord, make_date(mon // 100, mon % 100, 1) AS capture_date
  FROM gross_ g LEFT JOIN (SELECT settlement_id, sum(amount_paise) AS x FROM refunds_ GROUP BY 1) r USING (settlement_id)
  LEFT JOIN (SELECT settlement_id, sum(amount_paise) AS x FROM chargebacks_ GROUP BY 1) c USING (settlement_id)),
settlements_ AS (
  SELECT *, last_day(capture_date) AS event_date, 'UTRX' || lpad(ord::VARCHAR, 12, '0') AS utr,
    greatest(gross_paise - fee_paise - tax_paise - withholding_paise - refund_paise - chargeback_paise, 0) AS net_paise,
    greatest(-(gross_paise - fee_paise - tax_paise - withholding_paise - refund_paise - chargeback_paise), 0) AS carry_out FROM less_),
bank_ AS (
  SELECT 'bank_' || ord || copy AS bank_row_id, event_date + CASE WHEN ord % 7 = 0 THEN 9 ELSE 1 END AS event_date,
    CASE WHEN ord % 5 = 0 THEN substr('NEFT CR-RATN0000088-RAZORPAY SOFTWARE PVT LTD-' || utr, 1, 35) ELSE 'IMPS/' || utr || '/RAZORPAY SOFTWARE/PAYOUT' END AS narration,
    greatest(CASE WHEN net_paise = 0 THEN 0 ELSE net_paise - (ord % 11 = 0)::BIGINT - 5000 * (ord % 13 = 0)::BIGINT END, 0) AS credit_paise, 0::BIGINT AS debit_paise,
    CASE WHEN ord % 5 <> 0 THEN utr END AS utr
  FROM settlements_, (VALUES ('a'), ('b')) t(copy) WHERE ord % 17 <> 0 AND (copy = 'a' OR ord % 19 = 0)
  UNION ALL
  SELECT 'bank_e' || event_id, ts::DATE, 'NEFT-' || event_type, CASE WHEN event_id % 2 = 0 THEN round(value * 100)::BIGINT ELSE 0 END, CASE WHEN event_id % 2 = 1 THEN round(value * 100)::BIGINT ELSE 0 END, NULL FROM events),
credits_ AS (SELECT * FROM bank_ WHERE credit_paise > 0),
days_ AS (SELECT d::DATE AS day, isodow(d) < 6 AS open FROM generate_series(DATE '1994-01-01', DATE '2025-12-31', INTERVAL 1 DAY) t(d)),
cal_ AS (SELECT *, sum(open::INT) OVER (ORDER BY day) AS seq, sum(open::INT) OVER (ORDER BY day) + CASE WHEN open THEN 0 ELSE 1 END AS start FROM days_),
biz_ AS (SELECT seq, day FROM cal_ WHERE open)
"""
