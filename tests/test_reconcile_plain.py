"""The whole reconciliation, row by row, against the plain one: synthetic ledgers with every defect, and those of the tables."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import fields
from datetime import date

import pytest

from ledgerloom.config import Rates
from ledgerloom.plans import chain, trace
from ledgerloom.plans import findings as findings_plan
from ledgerloom.plans.findings import findings
from ledgerloom.plans.reconcile import Reconciliation, reconcile
from tests.generator import generate
from ledgerloom.sources.ledgers import Ledgers
from ledgerloom.sources.star import star_ledgers
from tests import plain_reconcile as plain


def compare(ledgers: Ledgers, rates: Rates) -> tuple[dict, Reconciliation]:
    want = plain.reconcile(**{f.name: [r.asDict() for r in getattr(ledgers, f.name).collect()] for f in fields(Ledgers)}, rates=rates)
    got = reconcile(ledgers, rates)
    rows = got.decisions.collect()
    decisions = {r["order_id"]: (r["outcome"], r["payment_id"], r["settlement_id"], r["bank_row_id"], r["tier"], r["confidence"]) for r in rows}
    assert len(rows) == len(decisions)
    same("decisions", decisions, want["decisions"])
    same("tied", {r["settlement_id"]: (r["bank_row_id"], r["tier"]) for r in got.tied.collect()}, want["tied"])
    same("verdicts", {r["settlement_id"]: (r["outcome"], r["bank_row_id"]) for r in got.verdicts.collect()}, want["verdicts"])
    same("dispositions", {r["bank_row_id"]: r["disposition"] for r in got.dispositions.collect()}, want["dispositions"])
    told = {r["gap_id"]: r for r in got.attributions.collect()}
    found = lambda level, n, outcome, item: (level, n, outcome, item)
    same("attributions", {k: found(r["level"], r["n_candidates"], r["outcome"], r["item_id"]) for k, r in told.items()}, {k: found(e["level"], e["n"], e["outcome"], e["item_id"]) for k, e in want["attributions"].items()})
    for k, e in want["attributions"].items():
        if e["expected"] is not None and (e["level"] != "L4" or e["n"] == 1):
            assert told[k]["expected"] == pytest.approx(e["expected"]), k
    return want, got


def same(name: str, got: dict, want: dict) -> None:
    off = {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)}
    assert not off, f"{name}: {len(off)} of {len(want)} differ, such as {dict(list(off.items())[:5])}"


@pytest.mark.parametrize("seed", [42, 7])
def test_synthetic_ledgers(spark, seed):
    want, _ = compare(generate(spark, 400, date(2026, 6, 1), 30, seed).ledgers, Rates())
    assert {d[0] for d in want["decisions"].values()} >= {"MATCHED", "ORDER_UNPAID", "DUPLICATE_PAYMENT"}


def test_ledgers_of_the_tables(spark, tiny):
    ledgers = star_ledgers(spark, tiny)
    want, got = compare(ledgers, Rates())
    assert {d[4] for d in want["decisions"].values()} >= {1, 2, 3, 5}
    details(ledgers, got)
    ends(ledgers, got)


def details(ledgers: Ledgers, r: Reconciliation) -> None:
    """Each finding's cause, exposure and shape, from the reconciliation's own rows."""
    rows = [x.asDict(recursive=True) for x in findings(r, ledgers, Rates().withholding_bps).collect()]
    verdicts = {v["settlement_id"]: v for v in r.verdicts.collect()}
    told = {a["settlement_id"]: a for a in r.attributions.collect()}
    day = {s["settlement_id"]: s["event_date"] for s in ledgers.settlements.collect()}
    credit = {b["bank_row_id"]: b["credit_paise"] for b in ledgers.bank.collect()}
    held, orders = defaultdict(list), defaultdict(list)
    for p in ledgers.payments.collect():
        held[p["settlement_id"]].append(p)
    for d in r.decisions.collect():
        if d["outcome"] != "MATCHED":
            orders[d["settlement_id"]].append(d)
    assert [x["place"] for x in sorted(rows, key=lambda x: (-x["rupees_paise"], x["group_id"]))] == list(range(1, len(rows) + 1))
    payouts = {x["settlement_id"]: x for x in rows if x["kind"] == "settlement"}
    assert payouts.keys() == {s for s, v in verdicts.items() if v["outcome"] != "MATCHED"} and len({x["code"] for x in rows if x["kind"] == "orders"}) == len(rows) - len(payouts)
    for s, x in payouts.items():
        v, a = verdicts[s], told.get(s)
        whole = v["outcome"] == "MISSING_IN_BANK" or not v["variance_paise"]
        assert x["rupees_paise"] == (v["expected_net_paise"] if whole else abs(v["variance_paise"])) and x["affected_chains"] == len(orders[s])
        if v["outcome"] == "MISSING_IN_BANK":
            cause = "payout never arrived"
        elif a and a["outcome"] == "ATTRIBUTED" and a["level"] in ("L1", "L2", "L3"):
            cause = f"{findings_plan.KINDS[a['level']]} {a['item_id']} "
        elif a and (a["n_candidates"] or 0) > 1:
            cause = f"{findings_plan.WORDS.get(a['n_candidates'], a['n_candidates'])} possible causes"
        else:
            cause = "" if v["identified_by"] == "attribution" or v["outcome"] == "TIMING_PENDING" else "cause not identified"
        assert x["headline"].startswith(f"{day[s]:%d %b} – {cause}"), x
        assert x["shape"] == {"orders": len({p["order_id"] for p in held[s]}), "payments": len(held[s]), "bank_rows": int(v["bank_row_id"] is not None)}
        t = x["arithmetic"]
        assert sum(e["paise"] for e in t["terms"]) == t["expected_paise"] or t["expected_paise"] == 0
        assert t["actual_paise"] == credit.get(v["bank_row_id"]) and len(x["candidates"]) == min(6, (a or {"n_candidates": 0})["n_candidates"] or len(x["candidates"]))
        assert x["records"][0]["id"] == s and len(x["records"]) == 1 + (v["bank_row_id"] is not None) + (len(x["evidence"]["attributed_item"].split("+")) if x["evidence"]["attributed_item"] else 0)
    for x in rows:
        if x["kind"] == "orders":
            mine = [d for d in orders[None] if d["outcome"] == x["code"]]
            assert (x["affected_chains"], x["shape"]["orders"], x["candidates"]) == (len(mine), len(mine), [])


def ends(ledgers: Ledgers, r: Reconciliation) -> None:
    """What became of every row, and its steps."""
    got = {(t["source"], t["entity_id"]): t for t in trace.traces(ledgers, r.declines, r.decisions, r.dispositions).collect()}
    assert len(got) == sum(df.count() for df in (ledgers.orders, ledgers.payments, ledgers.settlements, ledgers.bank))
    for d in r.decisions.collect():
        t = got["orders", d["order_id"]]
        assert (t["code"], t["state"]) == (d["outcome"], "matched" if d["outcome"] == "MATCHED" else "exception")
    for b in r.dispositions.collect():
        assert got["bank", b["bank_row_id"]]["state"] == b["disposition"].lower()
    for d in r.declines.collect():
        assert (d["tier"], d["reason"], d["caused_by"]) in {(s["tier"], s["reason"], s["caused_by"]) for s in got[d["kind"], d["entity_id"]]["steps"]}
    assert all("{" not in s["sentence"] for t in got.values() for s in t["steps"])
    broken = {c["order_id"]: c for c in chain.traced_chain(r, ledgers).collect()}
    assert all(c["chain_breaks_at"] is None for c in broken.values() if c["outcome"] == "MATCHED") and {c["chain_breaks_at"] for c in broken.values()} >= {None, "gateway payment"}
