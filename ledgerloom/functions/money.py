"""Money as integer paise: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_float(c: Column) -> Column:
    """Paise of a floating amount in rupees."""
    return F.round(c * 100).cast("long")


def parse_paise(text: Column) -> Column:
    """Paise of a decimal string: a sign, an optional fraction; digits beyond the second are cut, an empty text is 0."""
    t = F.trim(F.coalesce(text, F.lit("")))
    negative = t.startswith("-")
    plain = F.regexp_replace(t, r"^[+-]", "")
    whole = F.nullif(F.substring_index(plain, ".", 1), F.lit(""))
    part = F.when(F.instr(plain, ".") > 0, F.substring_index(plain, ".", -1)).otherwise("")
    paise = F.coalesce(whole.cast("long"), F.lit(0)) * 100 + F.rpad(F.substring(part, 1, 2), 2, "0").cast("long")
    return F.when(negative, -paise).otherwise(paise)


def format_rupees(p: Column) -> Column:
    a = F.abs(p)
    return F.concat(F.when(p < 0, "-").otherwise(""), F.floor(a / 100).cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def format_inr(p: Column) -> Column:
    """With the rupee sign and Indian grouping: the last three digits, then pairs."""
    a = F.abs(p)
    whole = F.floor(a / 100).cast("string")
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d{2})*\d{3}$)", ",")
    return F.concat(F.when(p < 0, "-").otherwise(""), F.lit("₹"), grouped, F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def apply_bps(amount: Column, bps: Column | int) -> Column:
    """amount * bps / 10000, half away from zero."""
    bps = F.lit(bps) if isinstance(bps, int) else bps
    half = F.when(amount < 0, F.lit(-5000)).otherwise(F.lit(5000)).cast("long")
    return F.call_function("div", amount.cast("long") * bps.cast("long") + half, F.lit(10000).cast("long"))


def within(a: Column, b: Column, tolerance: Column | int) -> Column:
    return F.abs(a - b) <= tolerance
