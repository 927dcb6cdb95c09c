"""Answers against nested evidence: what must pass, what must be flagged, and why."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import grounding, text

ARITH = {"settlement_id": "setl_20260708_005", "expected": "₹5,28,662.38", "actual": "₹5,27,156.38", "gap": "₹1,506.00", "steps": [{"tier": 3, "reason": "AMOUNT_VARIANCE_UNEXPLAINED", "caused_by": None}]}
MONEY = {"by_code": [{"code": "ORDER_UNPAID", "share": 0.41}, {"code": "MISSING_IN_BANK", "share": 0.12}]}
CHAIN = {"order_id": "ord_000412", "hops": [{"date": "2026-07-29"}, {"date": "2026-07-31"}]}
LINK = {"entity": "ord_000007", "steps": [{"caused_by": "setl_20260708_005"}]}
ONE, TWO = ({"siblings": {"DUPLICATE_PAYMENT": {"total_with_this_code": n}, "MISSING_IN_BANK": {"total_with_this_code": n}}} for n in (1, 2))
#: answer, tools, results, and which field of the verdict objects (none: it passes)
CASES = [
    ("The engine expected ₹5,28,662.38 for setl_20260708_005 and the bank credited ₹5,27,156.38, a gap of ₹1,506.00. Tier 3 recorded AMOUNT_VARIANCE_UNEXPLAINED.", ["settlement_breakdown"], [ARITH], None),
    ("A gap of 1506, or of 1,506.0.", ["settlement_breakdown"], [ARITH], None),
    ("I could not determine whether the failures cluster at the end of the month.", ["queue_breakdown"], [MONEY], None),
    ("I could not determine whether STRONG causes are more accurate than others; no tool says so.", ["queue_breakdown"], [MONEY], None),
    ("Order ord_000412 was captured on 2026-07-29 and settled on 2026-07-31.", ["trace_chain"], [CHAIN], None),
    ("ORDER_UNPAID holds more of the queue than MISSING_IN_BANK does.", ["queue_breakdown"], [MONEY], None),
    ("It was caused by setl_20260708_005.", ["why_not"], [LINK], None),
    ("This is the only DUPLICATE_PAYMENT finding.", ["compare_findings"], [ONE], None),
    (None, None, None, None),
    ("The gap on setl_20260708_005 was ₹9,99,999.99.", ["settlement_breakdown"], [ARITH], "numbers_unverified"),
    ("The credit bank_999999 was at fault.", ["settlement_breakdown"], [ARITH], "ids_unverified"),
    ("Tier 2 declined with BANK_WAS_ON_HOLIDAY.", ["settlement_breakdown"], [ARITH], "codes_unverified"),
    ("The payout probably failed, as banks were slow.", ["settlement_breakdown"], [ARITH], "speculative"),
    ("It was caused by the bank.", ["settlement_breakdown"], [ARITH], "speculative"),
    ("It failed because the merchant refunded it.", [], [], "uncaused"),
    ("Order ord_999999 traced cleanly to the bank.", ["trace_chain"], [{"error": "no decision recorded for ord_999999"}], "ids_unverified"),
    ("This is the only MISSING_IN_BANK finding in the queue.", ["compare_findings"], [TWO], "contradicted"),
    ("The reconciliation failures cluster at the end of the month.", ["queue_breakdown"], [MONEY], "claims"),
    ("The failures do not cluster at the end of the month; they are spread evenly.", ["queue_breakdown"], [MONEY], "claims"),
    ("Most of the failures happen in the last week of the month.", ["trace_chain"], [CHAIN], "claims"),
    ("STRONG causes are not more accurate than others.", ["queue_breakdown"], [MONEY], "claims"),
    ("This payout will most likely arrive in the next two business days.", ["queue_breakdown"], [MONEY], "claims"),
]


@pytest.mark.parametrize("ascii_", [True, False])
def test_answers_that_pass_and_that_do_not(spark, ascii_):
    rows = [(i, a, t, None if r is None else [json.dumps(x, ensure_ascii=ascii_) for x in r]) for i, (a, t, r, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, answer string, tools array<string>, results array<string>")
    got = {r["i"]: r["v"] for r in df.select("i", grounding.grounded(F.col("answer"), F.col("tools"), F.col("results")).alias("v")).collect()}
    for i, (answer, _, _, field) in enumerate(CASES):
        v = got[i].asDict()
        assert v["ok"] == (field is None), (answer, v)
        told = {k for k in ("numbers_unverified", "ids_unverified", "codes_unverified", "speculative", "claims") if v[k]} | {k for k in ("uncaused", "contradicted") if v[k]}
        assert field is None or field in told, (answer, v)


def test_claims_are_made_by_sentences(spark):
    cases = {
        "The spread is wide. We ship weekly.": [], "The spread is wide, weekly.": ["timing"], "Losses cluster on a weekday\nand no data shows it.": ["timing"],
        "It cannot say whether losses cluster weekly. They peak at month end. They will arrive tomorrow!": ["future", "timing"], "The forecast is more accurate": ["accuracy"], "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", grounding.claim_kinds(F.col("t")).alias("c")).collect()} == cases
    able = df.select(grounding.claim_kinds(F.lit("They peak at month end."), F.array(F.lit("temporal_distribution"))).alias("c")).first()
    assert able["c"] == []
    split = spark.createDataFrame([("One. Two!  Three?\n\nFour.five\n \n6",)], "t string").select(text.sentences(F.col("t")).alias("s")).first()["s"]
    assert split == ["One.", "Two!", "Three?", "Four.five", "6"]


def test_figures(spark):
    df = spark.createDataFrame([(t,) for t in ("1,234.50", "90.00", "1200", "0.10", "5,28,662.38")], "t string")
    assert [r[0] for r in df.select(grounding.digits(F.col("t"))).collect()] == ["1234.5", "90", "1200", "0.1", "528662.38"]


def test_an_answer_and_its_evidence_are_made_once(spark):
    made = lambda mark: F.concat(F.lit(mark), F.col("id").cast("string"), F.lit(" will probably land. The trend is monthly."))
    df = spark.range(3).select(grounding.grounded(made("ANSWER"), F.array(F.lit("get_entity")), F.array(made("RESULT"))).alias("v"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ANSWER") == 1 and plan.count("RESULT") <= 3  # the result is parsed, read for an error, or taken as it stands
    assert {(tuple(r["v"]["speculative"]), tuple(r["v"]["claims"])) for r in df.collect()} == {(("probably",), ("future", "timing"))}
    odd = spark.createDataFrame([(None,), ("",), ("ΣΊΓΜΑΣ PREDICT.",), ("İt WILL\tarrive",), ("No data. We will see.",)], "t string")
    assert [list(r[0]) for r in odd.select(grounding.claim_kinds(F.col("t"))).collect()] == [[], [], ["future"], ["future"], []]
