"""Rates, tolerances and vocabularies of the reconciliation."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Rates:
    """Fees in basis points, settlement timing and holidays."""

    mdr_bps: dict = field(default_factory=lambda: {"card": 200, "netbanking": 180, "wallet": 200, "upi": 0})
    tax_on_fee_bps: int = 1800
    withholding_bps: int = 100
    lag_days: int = 2
    cutoff_hour: int = 23
    holidays: tuple[date, ...] = (
        date(2026, 1, 26), date(2026, 3, 4), date(2026, 3, 21), date(2026, 4, 14), date(2026, 5, 1),
        date(2026, 8, 15), date(2026, 10, 2), date(2026, 11, 9), date(2026, 12, 25),
    )

    @staticmethod
    def from_yaml(path: str) -> Rates:
        import yaml

        with open(path) as f:
            raw = yaml.safe_load(f)
        wh = raw.get("withholding") or {}
        timing = raw.get("settlement") or {}
        days = [date.fromisoformat(str(d)) for k, v in raw.items() if k.startswith("holidays") for d in v]
        return Rates(raw["mdr_bps"], int(raw["tax_on_fee_bps"]), int(wh.get("rate_bps", 0)) if wh.get("enabled") else 0, int(timing.get("lag_business_days", 2)), int(timing.get("cutoff_hour", 23)), tuple(days))


#: Windows in business days, tolerances in paise, confidences.
EXACT_WINDOW, TOLERANT_WINDOW, NET_WINDOW = 3, 6, 3
BASE_TOLERANCE, PER_PAYMENT_TOLERANCE, NET_TOLERANCE = 2, 1, 2
SHAPE_THRESHOLD = 85.0
CONFIDENCE = {"utr_tolerant": 0.9, "narration_exact": 0.8, "narration_tolerant": 0.7, "equation": 0.95, "drift": 0.90, "rounding": 0.99, "single": 0.85, "pair": 0.75, "membership": 0.80}
STRONG_MAX, REFUSE_MIN = 0.01, 1.0
#: Worst first (fixed values).
PRECEDENCE = ("ORDER_UNPAID", "DUPLICATE_PAYMENT", "MISSING_IN_BANK", "CHARGEBACK_UNPOSTED", "AMOUNT_VARIANCE_UNEXPLAINED", "MATCHED")
#: Decline reason to exception code (fixed values); every other reason is UNKNOWN.
REASON_TO_CODE = {
    "NO_PAYMENT_FOR_ORDER": "ORDER_UNPAID",
    "MULTIPLE_PAYMENTS_FOR_ORDER": "DUPLICATE_PAYMENT",
    "ORDER_PAYMENT_AMOUNT_MISMATCH": "AMOUNT_VARIANCE_UNEXPLAINED",
    "PAYMENT_HAS_CHARGEBACK": "CHARGEBACK_UNPOSTED",
}
LEVELS = ("L0", "L1", "L2", "L3", "L4", "L5")
CASH_BUCKETS = ("confirmed", "expected", "at_risk", "disputed")
