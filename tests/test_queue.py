"""The queue's operators, checks of prose, and what had no test: files, the self-check's refusal, likeness of narrations."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.config import Rates
from ledgerloom.functions import text
from ledgerloom.operators import batches, scoring
from ledgerloom.plans import queue, views
from tests.generator import generate, to_text
from ledgerloom.sources.ledgers import FILES, load, read_text_csv, write_csv


def test_worst_outcome_by_precedence(spark):
    df = spark.createDataFrame([("a", "MATCHED"), ("a", "MISSING_IN_BANK"), ("a", "ORDER_UNPAID"), ("b", "ODD"), ("b", "MATCHED"), ("c", "ODD"), ("c", "EVEN")], "k string, o string")
    assert {r["k"]: r["worst"] for r in queue.worst(df, "k", "o").collect()} == {"a": "ORDER_UNPAID", "b": "MATCHED", "c": "EVEN"}
    assert C.PRECEDENCE[-1] == "MATCHED"


@pytest.mark.parametrize("row", [0, 5, 58, 99])
def test_page_holds_its_row_a_third_down(spark, row):
    rows = list(range(100))
    df = spark.createDataFrame([(i,) for i in random.Random(1).sample(rows, 100)], "i long")
    got = [(r["i"], r["at"]) for r in queue.page_with(df, "i", ["i"], row, 12).collect()]
    first = max(0, row - 4)
    assert sorted(got) == [(i, i) for i in rows[first : first + 12]]
    assert queue.page_with(df, "i", ["i"], 1000, 12).count() == 0


def test_prose_is_checked_for_every_shape_of_amount(spark):
    known = "bank_00012 ord_ab12 1,234.50 90.00"
    cases = [("Rs. 1,234.50 and ₹90 and INR 90.00", []), ("₹5,000", ["5000"]), ("Rs 12.5 for ord_ab12", ["12.5"]), ("12.34 in pay_9z", ["12.34", "pay_9z"]), ("7 of 12", []), (None, None)]
    df = spark.createDataFrame([(p, known) for p, _ in cases], "p string, e string")
    assert [r[0] for r in df.select(text.unsupported(F.col("p"), F.col("e"))).collect()] == [w for _, w in cases]


def test_claims_of_timing_need_a_period(spark):
    cases = [("Failures cluster at month end.", "timing"), ("Failures cluster in cards.", None), ("This band is more accurate.", "accuracy"), ("It will surely arrive soon", "future"), ("We predict so", "future"), ("It arrived", None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "s string").select([c.alias(k) for k, c in text.claims(F.col("s")).items()])
    for r, (_, want) in zip(df.collect(), cases, strict=True):
        assert [k for k, v in r.asDict().items() if v] == ([want] if want else [])


def test_rates_and_chains(spark):
    seen = spark.createDataFrame([("a", 210, 1000), ("b", 400, 1000), ("c", 0, 0), ("d", 1, 1)], "name string, observed long, n long")
    assert {r["name"]: r["passed"] for r in scoring.rate_checks(seen, {"a": 0.2, "b": 0.2, "c": 0.5}).collect()} == {"a": True, "b": False, "c": True}
    cycles = spark.createDataFrame([("k", 1, 0, 5), ("k", 2, 5, 7), ("k", 3, 6, 0), ("j", 1, 0, 9)], "k string, t int, i long, o long")
    assert [tuple(r) for r in scoring.carry_chain(cycles, ["k"], F.col("t"), "i", "o").collect()] == [("k", 2, 1)]


def plain_ratio(a, b):
    """Longest common subsequences by the textbook table, over every stretch."""

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            old = row[:]
            for j, d in enumerate(y):
                row[j + 1] = old[j] + 1 if c == d else max(old[j + 1], row[j])
        return row[-1]

    short, long_ = sorted((a, b), key=len)
    pieces = [long_[max(0, k) : k + len(short)] for k in range(1 - len(short), len(long_))]
    return max((200.0 * lcs(short, p) / (len(short) + len(p)) for p in pieces), default=0.0)


def test_narration_similarity_equals_the_table(spark):
    rng = random.Random(2)
    utr = "ABCD123456789012"
    texts = [t.format(utr=utr)[: rng.randint(1, 60)] for t in text.TEMPLATES for _ in range(3)] + ["SALARY JUNE", "NEFT", "", "x" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "n string")
    got = [r[0] for r in df.select(text.narration_similarity(F.col("n"), F.lit(utr))).collect()]
    want = [max(plain_ratio(t, p.format(utr=utr)[: len(t)]) for p in text.TEMPLATES) if t else 0.0 for t in texts]
    assert got == pytest.approx(want)


def test_files_load_as_they_were_written(spark, tmp_path):
    made = generate(spark, 120).ledgers
    for name, (file, columns) in FILES.items():
        write_csv(to_text(made, name).select(*columns).coalesce(1), f"{tmp_path}/{file}", quote_all=name == "bank")
    back = load(spark, str(tmp_path))
    assert back.orders.count() == made.orders.count() and back.counts().count() == 6
    rows = lambda l: sorted((r["settlement_id"], r["net_paise"]) for r in l.settlements.select("settlement_id", "net_paise").collect())
    assert rows(back) == rows(made)
    with pytest.raises(ValueError):
        read_text_csv(spark, str(tmp_path), "invoices")
    links = views.links_by_narration(back)
    assert links.join(back.settlements, "settlement_id", "left_anti").isEmpty() and links.count() > 0


def test_a_report_that_disagrees_is_refused(spark):
    l = generate(spark, 120).ledgers
    batches.assert_self_check(batches.build_batches(l.settlements, l.payments, l.refunds, l.chargebacks, Rates()))
    wrong = l.settlements.withColumn("net_paise", F.col("net_paise") + 1)
    with pytest.raises(batches.SelfCheckFailure):
        batches.assert_self_check(batches.build_batches(wrong, l.payments, l.refunds, l.chargebacks, Rates()))


def test_rates_from_yaml(tmp_path):
    yaml = pytest.importorskip("yaml")
    path = tmp_path / "rates.yaml"
    path.write_text(yaml.safe_dump({"mdr_bps": {"card": 150}, "tax_on_fee_bps": 1800, "withholding": {"enabled": True, "rate_bps": 10}, "settlement": {"lag_business_days": 3}, "holidays_2026": ["2026-01-26"]}))
    r = Rates.from_yaml(str(path))
    assert (r.mdr_bps["card"], r.withholding_bps, r.lag_days, r.cutoff_hour, len(r.holidays)) == (150, 10, 3, 23, 1)


def test_pool_totals_equal_the_listed_pools(spark):
    rng = random.Random(9)
    day = lambda n: date(2026, 3, 1) + timedelta(n)
    paid = [(f"p{k}", rng.choice([day(rng.randrange(12)), day(rng.randrange(12)), None]), rng.choice([rng.randrange(-9, 60), 30, rng.randrange(10**6), None])) for k in range(200)]
    asked = [(f"b{k}", rng.choice([day(rng.randrange(-3, 30)), None]), rng.choice([rng.randrange(60), 28, rng.randrange(10**6), None])) for k in range(80)] + [("b0", day(4), 10**6), ("late", day(90), 10**6)]
    p, c = spark.createDataFrame(paid, "payment_id string, due date, contribution long"), spark.createDataFrame(asked, "bank_row_id string, event_date date, credit_paise long")
    listed = queue.membership_pools(c, p, 4, 2).groupBy("bank_row_id").agg(F.count("*").alias("pool"), F.sum("contribution").alias("paise"))
    want = sorted(map(tuple, listed.collect()))
    for width in (1 << 16, 16):
        assert sorted(map(tuple, queue.pool_totals(c, p, 4, 2, width).collect())) == want
    assert len(want) > 10
