"""The reconciliation again over lists in plain Python, slowly, to compare row by row. It shares only the fixed values."""

from __future__ import annotations

from collections import Counter, defaultdict
from datetime import date, timedelta
from itertools import combinations

from ledgerloom import config as C
from ledgerloom.functions.text import TEMPLATES


def bps(amount: int, rate: int) -> int:
    q = (abs(amount) * rate * 2 + 10000) // 20000
    return q if amount >= 0 else -q


def later(day: date, n: int, holidays) -> date:
    is_open = lambda d: d.weekday() < 5 and d not in holidays
    while not is_open(day):
        day += timedelta(1)
    while n:
        day += timedelta(1)
        n -= is_open(day)
    return day


def common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for k, y in enumerate(b):
            row[k + 1] = last[k] + 1 if x == y else max(last[k + 1], row[k])
    return row[-1]


def likeness(narration: str | None, utr: str | None) -> float:
    best = 0.0
    for t in TEMPLATES if narration else ():
        p = t.format(utr=utr or "")[: len(narration)]
        a, b = sorted((narration, p), key=len)
        for i in range(len(b)):
            for j in range(i + 1, min(len(b), i + len(a)) + 1):
                if (j - i) * 2 / (len(a) + j - i) * 100 > best and (i == 0 or j == len(b) or j - i == len(a)):
                    best = max(best, 200.0 * common(a, b[i:j]) / (len(a) + j - i))
    return best


def chance(target: int, sums: list[int], tolerance: int) -> float:
    lo = max(1, target // 2)
    hi = max(lo + 1, target * 3 // 2)
    return sum(max(0, min(hi - 1, m + tolerance) - max(lo, m - tolerance) + 1) for m in sums) / (hi - lo)


def explain(delta: int, settlement: str, items: list[dict], tolerance: int = C.NET_TOLERANCE) -> dict:
    """level, outcome, item_id, n_candidates and the exact chance fits of what was found."""
    t = abs(delta)
    if t <= tolerance:
        return {"level": "L0", "outcome": "ROUNDING_DRIFT_ACCEPTED", "item_id": None, "n": 0, "expected": None}
    pool = [i for i in items if i["settlement_id"] != settlement]
    for level, kind in (("L1", "payment"), ("L2", "refund"), ("L3", "chargeback")):
        hits = [i["item_id"] for i in pool if i["kind"] == kind and abs(t - i["magnitude"]) <= tolerance]
        if hits:
            expected = chance(t, [i["magnitude"] for i in pool if i["kind"] == kind], tolerance)
            break
    else:
        at = defaultdict(list)
        for i in pool:
            at[i["magnitude"]].append(i["item_id"])
        pairs = set()
        for m, ids in at.items():
            for d in range(-tolerance, tolerance + 1):
                pairs |= {tuple(sorted((a, b))) for a in ids for b in at.get(t - m + d, ()) if a != b}
        level, hits, expected = "L4", ["+".join(p) for p in pairs], None
        if len(hits) == 1:
            m = [i["magnitude"] for i in pool if i["magnitude"] <= 2 * t]
            expected = chance(t, [a + b for a, b in combinations(m, 2)], tolerance)
    if not hits:
        return {"level": "L5", "outcome": "AMOUNT_VARIANCE_UNEXPLAINED", "item_id": None, "n": 0, "expected": None}
    if len(hits) > 1:
        return {"level": level, "outcome": "AMBIGUOUS_MULTI_CANDIDATE", "item_id": None, "n": len(hits), "expected": expected}
    sure = expected < C.REFUSE_MIN
    return {"level": level, "outcome": "ATTRIBUTED" if sure else "AMOUNT_VARIANCE_UNEXPLAINED", "item_id": hits[0] if sure else None, "n": 1, "expected": expected}


def reconcile(orders, payments, refunds, chargebacks, settlements, bank, rates: C.Rates) -> dict:
    """decisions {order: (outcome, payment, settlement, bank row, tier, confidence)}, verdicts, attributions, dispositions, tied."""
    own_pay, by_batch = defaultdict(list), defaultdict(list)
    for p in payments:
        own_pay[p["order_id"]].append(p)
        by_batch[p["settlement_id"]].append(p)
    disputed = {c["payment_id"] for c in chargebacks}
    credits = [b for b in bank if b["entry_type"] == "bank_credit"]
    tied, row_taken, decided, open_orders = {}, set(), {}, {}

    def gate(o):
        mine = own_pay.get(o["order_id"], [])
        if len(mine) != 1:
            return "NO_PAYMENT_FOR_ORDER" if not mine else "MULTIPLE_PAYMENTS_FOR_ORDER"
        if mine[0]["amount_paise"] != o["amount_paise"]:
            return "ORDER_PAYMENT_AMOUNT_MISMATCH"
        return "PAYMENT_HAS_CHARGEBACK" if mine[0]["payment_id"] in disputed else None

    for o in orders:
        mine = own_pay.get(o["order_id"], [])
        one = mine[0] if len(mine) == 1 else None
        open_orders[o["order_id"]] = {"gate": gate(o), "pay": one and one["payment_id"], "batch": one and one["settlement_id"]}

    def settle(tier, won):
        """won: {settlement: (row, confidence)}."""
        for s, (row, _) in won.items():
            tied[s] = (row, tier)
            row_taken.add(row)
        for k, o in list(open_orders.items()):
            if o["gate"] is None and o["batch"] in won:
                row, confidence = won[o["batch"]]
                decided[k] = ("MATCHED", o["pay"], o["batch"], row, tier, confidence)
                del open_orders[k]

    won = {}
    for s in sorted(settlements, key=lambda s: s["ord"]):
        fit = [c for c in credits if c["utr"] and c["utr"] == s["utr"] and c["credit_paise"] == s["net_paise"]]
        fit = [c for c in fit if s["event_date"] <= c["event_date"] <= later(s["event_date"], C.EXACT_WINDOW, rates.holidays)]
        if len(fit) == 1 and fit[0]["bank_row_id"] not in {r for r, _ in won.values()}:
            won[s["settlement_id"]] = (fit[0]["bank_row_id"], 1.0)
    settle(1, won)

    found = []
    for s in (s for s in settlements if s["settlement_id"] not in tied):
        width = C.BASE_TOLERANCE + C.PER_PAYMENT_TOLERANCE * len(by_batch.get(s["settlement_id"], []))
        last = later(s["event_date"], C.TOLERANT_WINDOW, rates.holidays)
        for c in credits:
            off = c["credit_paise"] - s["net_paise"]
            if c["bank_row_id"] in row_taken or abs(off) > width or not s["event_date"] <= c["event_date"] <= last:
                continue
            if c["utr"]:
                if c["utr"] == s["utr"]:
                    found.append((s["settlement_id"], c["bank_row_id"], C.CONFIDENCE["utr_tolerant"]))
            elif likeness(c["narration"], s["utr"]) >= C.SHAPE_THRESHOLD:
                found.append((s["settlement_id"], c["bank_row_id"], C.CONFIDENCE["narration_tolerant" if off else "narration_exact"]))
    left, right = Counter(s for s, _, _ in found), Counter(r for _, r, _ in found)
    settle(2, {s: (r, conf) for s, r, conf in found if left[s] == right[r] == 1})

    expected, items = {}, []
    for s in settlements:
        mine = by_batch.get(s["settlement_id"], [])
        gross = sum(p["amount_paise"] for p in mine)
        fees = [bps(p["amount_paise"], rates.mdr_bps[p["method"]]) for p in mine]
        back = sum(x["amount_paise"] for x in [*refunds, *chargebacks] if x["settlement_id"] == s["settlement_id"])
        raw = gross - sum(f + bps(f, rates.tax_on_fee_bps) for f in fees) - bps(gross, rates.withholding_bps) - back - s["carry_forward_in_paise"]
        expected[s["settlement_id"]] = max(raw, 0)
    for p in payments:
        items.append({"item_id": p["payment_id"], "kind": "payment", "settlement_id": p["settlement_id"], "magnitude": p["amount_paise"] - p["fee_paise"] - p["tax_paise"] - bps(p["amount_paise"], rates.withholding_bps)})
    for kind, rows in (("refund", refunds), ("chargeback", chargebacks)):
        items += [{"item_id": x["item_id"], "kind": kind, "settlement_id": x["settlement_id"], "magnitude": x["amount_paise"]} for x in rows]

    batches = [s for s in settlements if s["settlement_id"] not in tied]
    free = [b for b in bank if b["bank_row_id"] not in row_taken]
    free_credits = [b for b in free if b["entry_type"] == "bank_credit"]
    zeroes = [b for b in free if b["credit_paise"] == b["debit_paise"] == 0]
    as_of = max(b["event_date"] for b in bank)
    only = lambda rows: rows[0]["bank_row_id"] if len(rows) == 1 else None
    zero_of = {}
    for s in batches:
        if expected[s["settlement_id"]] == 0:
            z = only([b for b in zeroes if b["utr"] and b["utr"] == s["utr"]]) or only([b for b in zeroes if not b["utr"] and b["event_date"] == s["event_date"]])
            if z:
                zero_of[s["settlement_id"]] = z
    shared = Counter(zero_of.values())
    claims = {}
    for s in batches:
        sid, want = s["settlement_id"], expected[s["settlement_id"]]
        last = later(s["event_date"], C.NET_WINDOW, rates.holidays)
        timely = lambda b: s["event_date"] <= b["event_date"] <= last  # noqa: B023, E731
        near = [b["bank_row_id"] for b in [*free_credits, *zeroes] if timely(b) and abs(b["credit_paise"] - want) <= C.NET_TOLERANCE]
        by_utr = only([b for b in free_credits if b["utr"] and b["utr"] == s["utr"]])
        zero = zero_of.get(sid) if shared.get(zero_of.get(sid)) == 1 else None
        if len(near) > 1:
            claims[sid] = ("many", None)
        elif zero:
            claims[sid] = ("zero", zero)
        elif near:
            claims[sid] = ("amount", near[0])
        elif by_utr:
            claims[sid] = ("utr", by_utr)
        elif want == 0:
            claims[sid] = ("many", None)
        else:
            sure = []
            for b in filter(timely, free_credits):
                e = explain(want - b["credit_paise"], sid, items)
                if e["outcome"] == "ATTRIBUTED" and e["expected"] < C.STRONG_MAX:
                    sure.append((b["bank_row_id"], e["level"]))
            claims[sid] = ("many", None) if len(sure) > 1 else ("attribution", sure[0][0], sure[0][1]) if sure else ("pending" if as_of <= last else "missing", None)
    times = Counter(c[1] for c in claims.values() if c[1])
    verdicts, won, cause = {}, {}, set()
    paid = {b["bank_row_id"]: b["credit_paise"] for b in bank}
    for sid, (way, row, *level) in claims.items():
        clash = times[row] > 1
        if clash or way == "many":
            verdicts[sid] = ("AMBIGUOUS_MULTI_CANDIDATE", None)
        elif way in ("zero", "amount"):
            verdicts[sid] = ("MATCHED", row)
            won[sid] = (row, C.CONFIDENCE["equation" if way == "zero" or paid[row] == expected[sid] else "drift"])
        else:
            verdicts[sid] = ({"pending": "TIMING_PENDING", "missing": "MISSING_IN_BANK"}.get(way, "AMOUNT_VARIANCE_UNEXPLAINED"), row)
            if level == ["L3"]:
                cause.add(sid)
    settle(3, won)

    attributed = {}
    asked = {s: r for s, (r, _) in tied.items()}
    for s in settlements:
        if s["settlement_id"] not in tied:
            row = only([c for c in credits if c["utr"] and c["utr"] == s["utr"] and c["bank_row_id"] not in row_taken])
            if row:
                asked[s["settlement_id"]] = row
    for sid, row in asked.items():
        if expected[sid] != paid[row]:
            attributed[f"{sid}/{row}"] = e = explain(expected[sid] - paid[row], sid, items)
            if e["level"] == "L3" and e["outcome"] == "ATTRIBUTED":
                cause.add(sid)
    for k, o in open_orders.items():
        if o["gate"] is None and o["batch"] in verdicts:
            outcome, row = verdicts[o["batch"]]
            if outcome == "AMOUNT_VARIANCE_UNEXPLAINED" and o["batch"] in cause:
                outcome = "CHARGEBACK_UNPOSTED"
            decided[k] = (outcome, None, o["batch"], row, 3, 0.0)
        else:
            decided[k] = (C.REASON_TO_CODE.get(o["gate"], "UNKNOWN"), None, None, None, 5, 0.0)
    fate = {b["bank_row_id"]: "MATCHED" if b["bank_row_id"] in row_taken else "IGNORED" for b in bank if b["bank_row_id"] in row_taken or b["entry_type"] == "bank_debit"}
    return {"decisions": decided, "tied": tied, "verdicts": verdicts, "attributions": attributed, "dispositions": fate}
