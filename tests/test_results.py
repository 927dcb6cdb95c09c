"""Truth and result documents by contract, and the log of decisions."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from ledgerloom.operators import scoring
from ledgerloom.sources import results as R

CHAINS = [
    {"order_id": "o1", "expected_outcome": "MATCHED", "payment_ids": ["p1"], "settlement_ids": ["s1"], "bank_row_ids": ["b1", "b2"], "notes": {"any": ["thing"]}},
    {"order_id": "o2", "expected_outcome": "ORDER_UNPAID"}, {"order_id": "o3", "expected_outcome": "MATCHED", "payment_ids": None},
]
BAD = [{"expected_outcome": "MATCHED"}, {"order_id": "o9", "payment_ids": "p1"}, "text", 7, {"order_id": 5}, {"order_id": "o8", "bank_row_ids": ["b", {"x": 1}]}]


def write(folder, name, doc):
    Path(folder, name).write_text(doc if isinstance(doc, str) else json.dumps(doc))


def test_truth_and_what_it_rejects(spark, tmp_path):
    write(tmp_path, "a.json", {"chains": CHAINS + BAD, "seed": 1})
    write(tmp_path, "b.json", CHAINS[:1])
    write(tmp_path, "c.json", "{broken")
    good, bad = R.read_truth(spark, str(tmp_path))
    rows = good.collect()
    assert sorted(r["order_id"] for r in rows) == ["o1", "o1", "o2", "o3"]
    assert next(r for r in rows if r["order_id"] == "o1")["bank_row_ids"] == ["b1", "b2"] and next(r for r in rows if r["order_id"] == "o3")["payment_ids"] == []
    why = {(r["at"], r["why"]) for r in bad.collect()}
    assert why == {(3, "no order_id"), (4, "payment_ids is no list of texts"), (5, "no object"), (6, "no object"), (7, "order_id is no text"), (8, "bank_row_ids is no list of texts"), (None, "no JSON")}


@pytest.mark.parametrize("shape", ["object", "list"])
def test_results_in_either_shape_are_scored(spark, tmp_path, shape):
    decisions = [{"order_id": "o1", "payment_ids": ["p1"], "bank_row_ids": ["b2", "b1"]}, {"order_id": "o2", "outcome": "MATCHED", "payment_ids": ["p7"]}, {"order_id": "o3", "outcome": "UNKNOWN"}, {"order_id": "o1", "outcome": "UNKNOWN"}]
    Path(tmp_path, "r").mkdir()
    Path(tmp_path, "t").mkdir()
    write(tmp_path / "r", "r.json", decisions if shape == "list" else {"decisions": decisions, "bank_dispositions": {"b1": "MATCHED", "b9": "IGNORED"}})
    write(tmp_path / "t", "t.json", {"chains": CHAINS})
    said, disposed, bad = R.read_result(spark, str(tmp_path / "r"))
    truth, _ = R.read_truth(spark, str(tmp_path / "t"))
    assert bad.count() == 0 and {r["bank_row_id"]: r["disposition"] for r in disposed.collect()} == ({} if shape == "list" else {"b1": "MATCHED", "b9": "IGNORED"})
    rows = {r["order_id"]: r for r in R.linked(said, truth).collect()}
    assert {k: (r["outcome"], r["errors"]) for k, r in rows.items()} == {"o1": ("MATCHED", []), "o2": ("MATCHED", ["wrong_payments"]), "o3": ("UNKNOWN", [])}
    s = scoring.score(R.linked(said, truth), truth.withColumnRenamed("expected_outcome", "expected").select("order_id", "expected")).first()
    assert (s["orders"], s["claims"], s["right_claims"], s["exception_accuracy"]) == (3, 2, 1, 0.0)


def test_results_round_trip(spark, tmp_path):
    rows = [("o1", "MATCHED", "p1", "s1", "b1"), ("o2", "UNKNOWN", None, None, None)]
    d = spark.createDataFrame(rows, "order_id string, outcome string, payment_id string, settlement_id string, bank_row_id string")
    R.write_result(d, f"{tmp_path}/out")
    said, _, bad = R.read_result(spark, f"{tmp_path}/out", lines=True)
    assert bad.count() == 0 and {(r["order_id"], r["outcome"], *[(r[c] or [None])[0] for c in R.IDS]) for r in said.collect()} == set(rows)


def test_a_log_is_only_added_to(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    queue = spark.createDataFrame([("g1", 500), ("g2", 300), ("g3", 20)], "group_id string, rupees_paise long")
    say = lambda *rows: spark.createDataFrame(rows, "group_id string, action string, note string, at string")
    assert R.decision_log(spark, log).collect() == [] and R.remaining(queue, R.decision_log(spark, log)).first().asDict() == {"findings": 3, "decided": 0, "open": 3, "open_paise": 820}
    R.append_decisions(log, say(("g1", "approve", None, "2026-08-01 10:00:00"), ("g2", "escalate", "who?", "2026-08-01 10:00:00")), queue, "mon")
    R.append_decisions(log, say(("g2", "reject", "", "2026-08-02 10:00:00")), queue, "tue")
    R.append_decisions(log, say(("g3", "approve", "rerun", "2026-08-03 10:00:00")), queue, "tue")  # the batch is there: nothing changes
    rows = R.decision_log(spark, log).collect()
    assert sorted((r["batch"], r["group_id"], r["action"]) for r in rows) == [("mon", "g1", "approve"), ("mon", "g2", "escalate"), ("tue", "g2", "reject")]
    Path(tmp_path, "log", "batch=torn").mkdir()  # a batch without its marker isn't seen
    assert {(r["group_id"], r["action"], r["decided"]) for r in R.last_decisions(R.decision_log(spark, log)).collect()} == {("g1", "approve", 1), ("g2", "reject", 2)}
    assert R.remaining(queue, R.decision_log(spark, log)).first().asDict() == {"findings": 3, "decided": 2, "open": 1, "open_paise": 20}
    with pytest.raises(ValueError, match="delete"):
        R.append_decisions(log, say(("g1", "delete", "", "2026-08-03 10:00:00")), queue, "wed")
    with pytest.raises(KeyError, match="g9"):
        R.append_decisions(log, say(("g9", "reject", "", "2026-08-03 10:00:00")), queue, "wed")
