"""References in bank narrations, and checks of prose against its evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference (fixed value).
UTR = r"(?<![A-Z0-9])([A-Z]{4}\d{12})(?![0-9])"
#: Narrations of a payout (fixed values); {utr} is its reference.
TEMPLATES = (
    "NEFT-RAZORPAY SOFTWARE PRIVATE LIMITED-{utr}-SETTLEMENT",
    "IMPS/{utr}/RAZORPAY SOFTWARE/PAYOUT",
    "NEFT CR-RATN0000088-RAZORPAY SOFTWARE PVT LTD-{utr}",
    "RTGS-{utr}-RAZORPAYSOFTWARE-MERCHANT SETTLEMENT",
)


def bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` made once however often it is used: inside lambdas Spark makes an expression anew at each place."""
    return F.get(F.transform(F.array(value), use), 0)


def extract_utr(narration: Column) -> Column:
    """The first reference in a narration: four capitals and twelve digits that stand alone; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(narration), UTR, 1), F.lit(""))


def matched_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit for each character of a."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def partial_ratio(a: str, b: str) -> float:
    """Best indel similarity, 0 to 100, of the shorter text with any stretch of the longer of at most its length."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long_ else 0.0
    best, n = 0.0, len(short)
    for at in range(1 - n, len(long_)):
        piece = long_[max(0, at) : at + n]
        best = max(best, 200.0 * matched_length(short, piece) / (n + len(piece)))
    return best


def narration_similarity(narration: Column, utr: Column, templates: tuple[str, ...] = TEMPLATES) -> Column:
    """How much a narration looks like a payout's, each template cut to the narration's length.

    A narration that is a template's beginning is 100 without Python; every other is compared at all alignments.
    """
    whole = F.lit(False)
    for p in templates:
        whole = whole | F.startswith(F.replace(F.lit(p), F.lit("{utr}"), F.coalesce(utr, F.lit(""))), narration)
    whole = F.coalesce(whole, F.lit(False)) & (F.length(narration) > 0)

    @F.pandas_udf("double")
    def score(texts: pd.Series, utrs: pd.Series) -> pd.Series:
        return pd.Series([max(partial_ratio(t, p.format(utr=u or "")[: len(t)]) for p in templates) if t else 0.0 for t, u in zip(texts, utrs, strict=True)], dtype="float64")

    return F.when(whole, 100.0).otherwise(score(F.when(~whole, narration), utr))


#: Amounts and ids in a prose (fixed values): with a currency's sign in any shape, without one only with two decimals.
MONEY = r"(?:Rs\.?|₹|INR)\s*[0-9][0-9,]*(?:\.[0-9]{1,2})?|[0-9][0-9,]*\.[0-9]{2}\b"
ID = r"\b(?:ord|pay|rfnd|cb|setl|bank)_[0-9A-Za-z_]+\b"
#: Phrases of claims that no evidence here can bear out (fixed values).
DISTRIBUTION = ("cluster", "concentrat", "spread", "trend", "seasonal", "distribut", "most of the", "majority of", "more likely on", "peak")
PERIOD = (
    "month end", "month-end", "end of the month", "over time", "weekend", "weekday", "day of the week", "time of day", "per month", "per week", "monthly", "weekly",
    "daily", "last week of", "early in the month", "late in the month", "start of the month", "each quarter", "by date",
)
ACCURACY = (
    "more accurate", "less accurate", "as accurate", "most accurate", "more reliable", "less reliable", "better calibrated", "worse calibrated", "accuracy of the",
    "correctness rate", "hit rate of", "more trustworthy", "less trustworthy",
)
FORWARD = ("in the next ", "in the coming ", "forecast", "expected to arrive", "going to arrive", "predict")
ARRIVAL = r"\bwill\b[^.]{0,40}\b(arrive|land|be credited|be paid|clear|come in|show up)\b"


def money_tokens(prose: Column) -> Column:
    """Amounts named in a prose, as plain digits."""
    plain = lambda x: F.rtrim(F.regexp_replace(x, r"^(?:Rs\.?|₹|INR)\s*|,", ""), F.lit("."))
    return F.transform(F.regexp_extract_all(prose, F.lit(MONEY), 0), plain)


def id_tokens(prose: Column) -> Column:
    return F.regexp_extract_all(prose, F.lit(ID), 0)


def unsupported(prose: Column, evidence: Column) -> Column:
    """Amounts and ids of a prose that its evidence, a text, doesn't hold; an amount may be named in whole rupees."""
    said = F.array_distinct(F.concat(money_tokens(prose), id_tokens(prose)))
    own = money_tokens(evidence)
    known = F.concat(own, F.transform(own, lambda x: F.substring_index(x, ".", 1)), id_tokens(evidence))
    return F.array_sort(F.array_except(said, known))


def claims(sentence: Column) -> dict[str, Column]:
    """Whether a sentence speaks of timing (a distribution over periods), of accuracy, or of the future."""
    return low_claims(F.lower(sentence))


def low_claims(low: Column) -> dict[str, Column]:
    """``claims`` of a sentence in lower case."""
    future = low_has_any(low, FORWARD) | low.rlike(ARRIVAL)
    return {"timing": low_has_any(low, DISTRIBUTION) & low_has_any(low, PERIOD), "accuracy": low_has_any(low, ACCURACY), "future": future}


def has_any(prose: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    return low_has_any(F.lower(prose), phrases)


def low_has_any(low: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    """``has_any`` of a prose in lower case."""
    return F.greatest(*[F.contains(low, F.lit(p.lower())) for p in phrases]) if len(phrases) > 1 else F.contains(low, F.lit(phrases[0].lower()))


def sentences(prose: Column) -> Column:
    """Split behind full stops, question and exclamation marks and at line feeds; blank ones are left out."""
    return F.filter(F.split(F.coalesce(prose, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")
