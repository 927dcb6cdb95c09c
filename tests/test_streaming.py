"""The exact tier over streams, arriving in two parts: pairs at once, the missing after their window."""

from __future__ import annotations

from datetime import date, timedelta

from ledgerloom.functions.calendar import business_calendar
from ledgerloom.streaming.exact import drain, exact_stream

S, C = "settlement_id string, utr string, net_paise long, event_date date", "bank_row_id string, utr string, credit_paise long, event_date date"


def test_pairs_and_missing(spark, tmp_path):
    first = date(2026, 7, 1)
    on = lambda n: first + timedelta(days=n)
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    put([("s1", "U1", 100, on(0)), ("s2", "U2", 200, on(0)), ("s3", "U3", 300, on(0)), ("s4", None, 1, on(0)), ("s5", "U5", 500, on(0))], S, "s")
    put([("b1", "U1", 100, on(1)), ("b2", "U2", 201, on(1)), ("b5", "U5", 500, on(9)), ("b0", None, 300, on(1))], C, "c")
    cal = business_calendar(spark, date(2026, 6, 1), date(2026, 12, 1))
    run = lambda: drain(exact_stream(spark.readStream.schema(S).parquet(f"{tmp_path}/s"), spark.readStream.schema(C).parquet(f"{tmp_path}/c"), cal), f"{tmp_path}/out")
    got = sorted(((r["settlement_id"], r["bank_row_id"]) for r in run().collect()), key=repr)
    assert got == [("s1", "b1")]
    # the second part brings a credit within the window, and rows far enough ahead for the rest to be overdue
    put([("b3", "U3", 300, on(2))], C, "c")
    assert sorted((r["settlement_id"], r["bank_row_id"]) for r in run().where("bank_row_id is not null").collect()) == [("s1", "b1"), ("s3", "b3")]
    put([("s9", "U9", 900, on(90))], S, "s")
    put([("b9", "U9", 900, on(91))], C, "c")
    got = sorted(((r["settlement_id"], r["bank_row_id"]) for r in run().collect()), key=repr)
    assert [x for x in got if x[1]] == [("s1", "b1"), ("s3", "b3"), ("s9", "b9")]
    assert {x[0] for x in got if not x[1]} == {"s2", "s4", "s5"}
