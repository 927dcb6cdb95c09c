"""Payouts identified by what explains their gap: the credits of a payout's window that one cause alone accounts for.

A cause counts only where chance doesn't explain as much (``STRONG``). A histogram of the items' amounts, in bins of
equal ratio, gives for every size of gap a number of chance fits that there surely are; sizes at which this floor is
too high for a strong cause are left out, exactly. What is left, the sizes' own causes, can't be many: fewer than
``STRONG_MAX`` of them fit a gap on average, so up to any size their number is bounded by it, not by the ledgers.

So there are two ways to the gaps worth looking at, with equal results: each payout with each credit of its days,
or each payout with each strong cause, looked up among the credits by day and amount. The rows of both are counted first,
and the way with fewer is gone. With few ledger rows that is the first; with many, when sparse sizes are rare, the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.operators import attribution as A
from ledgerloom.operators.chance import CELLS, Floors, cell_of, chance_floors
from ledgerloom.sources.checkpoints import cut

#: Strong causes that may be broadcast; beyond it payouts meet the credits of their days.
MOST_CAUSES = 1_000_000


def _within(cells: list[int]) -> Column:
    return F.col("cell").isin(cells) if cells else F.lit(False)


def single_causes(items: DataFrame, floors: Floors, most: float = C.STRONG_MAX) -> DataFrame:
    """(size): the distinct amounts of single items that lie in cells where a strong cause of their kind is possible."""
    tol = floors.tolerance
    parts = items.sparkSession.createDataFrame([], "size long")
    for kind in sorted(floors.single):
        own = items.where((F.col("kind") == kind) & (F.col("magnitude") > 0)).select(F.col("magnitude").cast("long").alias("size")).distinct()
        near = own.withColumn("near", F.explode(F.array(*[F.col("size") + d for d in range(-tol, tol + 1)]))).withColumn("cell", cell_of(F.col("near")))
        parts = parts.unionByName(near.where(_within(floors.open_cells(kind, most))).select("size"))
    return parts.distinct()


def pair_causes(items: DataFrame, floors: Floors, most: float = C.STRONG_MAX) -> DataFrame:
    """(size): the distinct sums of two items that lie in cells where a strong pair is possible."""
    tol = floors.tolerance
    amounts = cut(items.where("magnitude > 0").groupBy(F.col("magnitude").cast("long").alias("m")).agg(F.count("*").alias("n")))
    open_ = floors.open_cells("pair", most)
    lo = lambda c: F.floor(F.pow(F.lit(2.0), F.col(c) / CELLS) * (1 - 1e-9)).cast("long") - tol
    cells = amounts.sparkSession.createDataFrame([(k,) for k in open_], "cell long").withColumns({"lo": lo("cell"), "hi": F.ceil(F.pow(F.lit(2.0), (F.col("cell") + 1) / CELLS) * (1 + 1e-9)).cast("long") + tol})
    cells = cells.withColumn("width", F.col("hi") - F.col("lo") + 1)
    # a row for each open cell and each amount that fits twice into it; partners lie in two buckets of the cell's width
    small = F.broadcast(cells)
    left = amounts.join(small, F.col("m") * 2 <= F.col("hi")).select("cell", "lo", "hi", "width", "m", "n")
    left = left.withColumn("b", F.explode(F.sequence(F.floor((F.col("lo") - F.col("m")) / F.col("width")), F.floor((F.col("hi") - F.col("m")) / F.col("width")))))
    right = amounts.withColumnsRenamed({"m": "other", "n": "n_other"}).join(small, F.col("other") <= F.col("hi")).select("cell", "other", "n_other", F.floor(F.col("other") / F.col("width")).alias("b"))
    total = F.col("m") + F.col("other")
    pairs = left.join(right, ["cell", "b"]).where((F.col("m") <= F.col("other")) & total.between(F.col("lo"), F.col("hi")) & ((F.col("m") < F.col("other")) | (F.col("n") > 1)))
    return pairs.select(total.alias("size")).distinct()


def gaps_by_day(batches: DataFrame, credits: DataFrame, floors: Floors, most: float = C.STRONG_MAX) -> DataFrame:
    """(settlement_id, bank_row_id, delta): each payout with each credit of its days, in cells where a strong cause is possible."""
    days = batches.select("settlement_id", "expected_net_paise", F.explode(F.sequence("event_date", "hi")).alias("event_date"))
    seen = days.join(credits.select("event_date", "bank_row_id", "credit_paise"), "event_date")
    delta = (F.col("expected_net_paise") - F.col("credit_paise")).cast("long")
    cells = sorted({c for which in [*floors.single, "pair"] for c in floors.open_cells(which, most)})
    return seen.select("settlement_id", "bank_row_id", delta.alias("delta")).where(F.abs("delta") > floors.tolerance).withColumn("cell", cell_of(F.abs("delta"))).where(_within(cells)).drop("cell")


def gaps_by_cause(batches: DataFrame, credits: DataFrame, causes: DataFrame, tolerance: int) -> DataFrame:
    """(settlement_id, bank_row_id, delta): payouts and credits of their days that differ by a cause (size), looked up by week and amount."""
    width, epoch = 2 * tolerance + 1, F.lit("1970-01-01").cast("date")
    week = lambda day: F.floor(F.datediff(day, epoch) / 7)
    asked = batches.select("settlement_id", "expected_net_paise", "event_date", "hi", F.explode(F.sequence(week(F.col("event_date")), week(F.col("hi")))).alias("week"))
    highest = credits.agg(F.max("credit_paise")).first()[0] or 0
    met = asked.join(F.broadcast(causes), (F.col("size") <= F.col("expected_net_paise") + tolerance) | (F.col("size") + F.col("expected_net_paise") <= highest + tolerance))  # at most MOST_CAUSES sizes
    want = met.withColumn("want", F.explode(F.array(F.col("expected_net_paise") - F.col("size"), F.col("expected_net_paise") + F.col("size")))).where(F.col("want").between(-tolerance, highest + tolerance))
    at = F.floor(F.col("credit_paise") / width)
    keyed = credits.select("bank_row_id", "credit_paise", F.col("event_date").alias("posted"), week(F.col("event_date")).alias("week"), F.explode(F.array(at - 1, at, at + 1)).alias("k"))
    hits = want.withColumn("k", F.floor(F.col("want") / width)).join(keyed, ["week", "k"])
    hits = hits.where((F.abs(F.col("want") - F.col("credit_paise")) <= tolerance) & F.col("posted").between(F.col("event_date"), F.col("hi")))
    return hits.select("settlement_id", "bank_row_id", (F.col("expected_net_paise") - F.col("credit_paise")).cast("long").alias("delta")).where(F.abs("delta") > tolerance).distinct()


def identified(batches: DataFrame, credits: DataFrame, items: DataFrame, tolerance: int = C.NET_TOLERANCE, way: str | None = None) -> DataFrame:
    """(settlement_id, bank_row_id, delta, level, item_id, expected) of the credits that one strong cause explains.

    batches: settlement_id, expected_net_paise, event_date, hi; credits: bank_row_id, event_date, credit_paise; items as
    ``attribution.item_pool`` gives them. As there, the first level at which anything fits decides. ``way``: "day" or
    "cause"; by default the one with fewer rows, which are counted.
    """
    most = C.STRONG_MAX
    floors = chance_floors(items, tolerance)
    causes = None
    if way is None:
        per_day = batches.select(F.explode(F.sequence("event_date", "hi")).alias("event_date")).groupBy("event_date").agg(F.count("*").alias("b"))
        met = per_day.join(credits.groupBy("event_date").agg(F.count("*").alias("c")), "event_date").agg(F.sum(F.col("b") * F.col("c"))).first()[0] or 0
        asked = 2 * batches.count()
        some = met and items.where("magnitude <= 0").isEmpty()  # causes are looked for among positive amounts only
        way = "cause" if some and asked * single_causes(items, floors, most).count() < met else "day"
        least = met
    else:
        asked = least = None
    if way == "cause":
        causes = cut(single_causes(items, floors, most).unionByName(pair_causes(items, floors, most)).distinct())
        if least is not None:
            n = causes.count()
            way = "cause" if n <= MOST_CAUSES and asked * n < least else "day"
    found = gaps_by_cause(batches, credits, causes, tolerance) if way == "cause" else gaps_by_day(batches, credits, floors, most)
    gaps = cut(found.select(F.concat_ws("/", "settlement_id", "bank_row_id").alias("gap_id"), "settlement_id", "bank_row_id", "delta"))
    if gaps.isEmpty():
        return gaps.select("settlement_id", "bank_row_id", "delta", *[F.lit(None).cast(t).alias(c) for c, t in (("level", "string"), ("item_id", "string"), ("expected", "double"))])
    first = A.first_singles(gaps, items, tolerance)
    alone = gaps.join(first.where("n_candidates = 1").select("gap_id"), "gap_id", "left_semi")
    fits = A.single_fits(alone, items, tolerance)
    one = first.where("n_candidates = 1").join(fits.select("gap_id", "kind", "expected"), ["gap_id", "kind"]).select("gap_id", "level", "item_id", "expected")
    rest = gaps.join(first.select("gap_id"), "gap_id", "left_anti").withColumn("cell", cell_of(F.abs("delta"))).where(_within(floors.open_cells("pair", most))).drop("cell")
    rest = cut(rest.where(F.abs("delta") <= 2 * floors.top + tolerance))
    two = A.lone_pairs(rest, cut(A.pair_counts(rest, items, tolerance)), items, tolerance).select("gap_id", F.lit("L4").alias("level"), "item_id", F.col("chance").alias("expected"))
    sure = one.unionByName(two).where(F.col("expected") < most)
    return gaps.join(sure, "gap_id").select("settlement_id", "bank_row_id", "delta", "level", "item_id", "expected")
