"""Prose of exception groups says what their facts say, and other prose is found out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.explain import explain, verified, with_cache

G = "group_key string, code string, chain_count long, total_paise long"


def test_templates_are_grounded(spark):
    rows = [("setl_20260701_001", "MISSING_IN_BANK", 3, 123456789), ("ORDER_UNPAID", "ORDER_UNPAID", 1, 5), (None, None, None, None), ("x", "NEW_CODE", 2, 100000)]
    got = verified(explain(spark.createDataFrame(rows, G))).collect()
    assert len(got) == 4 and all(r["grounded"] for r in got)
    assert "3 orders worth ₹12,34,567.89" in next(r["prose"] for r in got if r["code"] == "MISSING_IN_BANK")


def test_other_amounts_and_ids_are_found_out(spark):
    made = explain(spark.createDataFrame([("setl_20260701_001", "MISSING_IN_BANK", 3, 123456789)], G))
    false = verified(made.withColumn("prose", F.concat("prose", F.lit(" So ₹99.00 of setl_20260702_001 is lost.")))).first()
    assert not false["grounded"] and len(false["unsupported"]) == 2


def test_stale_prose_is_not_taken(spark):
    made = explain(spark.createDataFrame([("a", "ORDER_UNPAID", 1, 5), ("b", "ORDER_UNPAID", 1, 5)], G))
    cache = made.where("group_key = 'a'").select("group_key", "record_hash", F.lit("kept").alias("prose")).unionByName(spark.createDataFrame([("b", "old", "stale")], "group_key string, record_hash string, prose string"))
    assert {r["group_key"]: (r["source"], r["prose"] == "kept") for r in with_cache(made, cache).collect()} == {"a": ("cache", True), "b": ("template", False)}


def test_prose_of_findings_and_what_it_may_say(spark):
    import datetime

    from ledgerloom.plans import explain

    day = datetime.date(2026, 7, 5)
    rows = [
        ("settlement", "MISSING_IN_BANK", "setl_1", day, 123456789, 3, None, None), ("settlement", "CHARGEBACK_UNPOSTED", "setl_2", day, 50000, 2, "L3", "cb_9"), ("settlement", "AMOUNT_VARIANCE_UNEXPLAINED", "setl_3", day, 700, 2, "L1", None),
        ("settlement", "AMOUNT_VARIANCE_UNEXPLAINED", "setl_4", day, 800, 2, "L5", None), ("orders", "ORDER_UNPAID", None, None, 990, 4, None, None), ("orders", "ODD", None, None, None, None, None, None),
    ]
    q = spark.createDataFrame(rows, "kind string, code string, settlement_id string, settled_on date, rupees_paise long, affected_chains long, level string, item_id string")
    got = explain.checked_prose(explain.explain_findings(q)).collect()
    assert all(r["check"]["ok"] for r in got), got
    assert got[0]["prose"] == "The payout of 5 July 2026, ₹12,34,567.89, was reported, and no credit shows it."
    assert got[1]["prose"] == "The payout of 5 July 2026 differs by ₹500.00, as chargeback cb_9 does. Only the amounts match, which is not proof."
    assert [("several items" in r["prose"], "no item" in r["prose"]) for r in got[2:4]] == [(True, False), (False, True)] and got[4]["prose"].startswith("4 orders worth ₹9.90")
    said = {
        "The gap was caused by cb_9, not proof.": "asserted", "It differs by ₹500.00, as cb_9 does.": "caveat_missing", "It differs by ₹ .": "blank", "": "blank", "It differs by ₹501.00.": "unsupported", "See cb_10; this is not proof.": "unsupported",
        "It differs by  ₹500.00.": "blank", "It fits {item}.": "blank",
    }
    one = q.where("item_id = 'cb_9'").crossJoin(spark.createDataFrame([(k,) for k in said], "prose string"))  # one row and a list
    for r in explain.checked_prose(one).collect():
        assert not r["check"]["ok"] and r["check"][said[r["prose"]]], r
