"""What explains a payout that differs from its expected net: single items, then pairs, with the odds of a chance fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.operators.batches import net_contribution
from ledgerloom.operators.chance import cell_of, chance_floors
from ledgerloom.sources.checkpoints import cut

LEVEL_OF = {"payment": "L1", "refund": "L2", "chargeback": "L3"}


def item_pool(payments: DataFrame, refunds: DataFrame, chargebacks: DataFrame, withholding_bps: int) -> DataFrame:
    """(item_id, kind, magnitude, item_settlement): what can be missing from a payout or too much in it."""
    own = payments.select(F.col("payment_id").alias("item_id"), F.lit("payment").alias("kind"), net_contribution(F.col("amount_paise"), F.col("fee_paise"), F.col("tax_paise"), withholding_bps).alias("magnitude"), F.col("settlement_id").alias("item_settlement"))
    rest = lambda df, kind: df.select("item_id", F.lit(kind).alias("kind"), F.col("amount_paise").alias("magnitude"), F.col("settlement_id").alias("item_settlement"))
    return own.unionByName(rest(refunds, "refund")).unionByName(rest(chargebacks, "chargeback"))


def band(expected: Column) -> Column:
    return F.when(expected < C.STRONG_MAX, "STRONG").when(expected < C.REFUSE_MIN, "CIRCUMSTANTIAL").otherwise("REFUSE")


def analytic_fits(n: Column, window: Column, spread: Column) -> Column:
    """Chance fits expected of n candidates spread evenly over a range; infinite without one."""
    return F.when(n <= 0, 0.0).when(spread <= 0, float("inf")).otherwise(n * window / F.nullif(spread, F.lit(0)))


def measured_fits(overlap: Column, low: Column, high: Column) -> Column:
    """Mean number of candidates within the window of a target drawn evenly from [low, high): the whole mean, not a sample of it."""
    return overlap / (high - low)


def single_fits(gaps: DataFrame, items: DataFrame, tolerance: int, scope: list[str] | None = None, width: int = 1 << 20) -> DataFrame:
    """(gap_id, kind, n, expected): for each gap and kind, the pool's size and the chance fits of one item.

    gaps: gap_id, settlement_id, delta. An item m fits a target t if it lies within the tolerance, so over targets
    drawn from half to one and a half times the gap it counts with its share of them. That mean is a difference of
    four sums g(u) of u - m over the items below u, which are read off running counts and sums over the sorted pool:
    within buckets of ``width`` by a window, before them from the buckets' totals. No gap meets an item, except
    those of its own settlement, which are taken out.
    """
    scope = scope or []
    keys = [*scope, "kind"]
    t = F.abs("delta")
    low = F.greatest(F.lit(1), F.floor(t / 2))
    g = gaps.select("gap_id", "settlement_id", *scope, low.alias("lo"), F.greatest(low + 1, F.floor(t * 3 / 2)).alias("hi"))
    ends = [F.col("hi") + tolerance, F.col("hi") - 1 - tolerance, F.col("lo") + tolerance, F.col("lo") - 1 - tolerance]
    points = F.explode(F.array(*[F.struct(F.lit(sign).alias("sign"), u.cast("long").alias("u")) for sign, u in zip((1, -1, -1, 1), ends, strict=True)]).cast("array<struct<sign:int,u:bigint>>"))
    kinds = F.explode(F.array(*[F.lit(k) for k in LEVEL_OF])).alias("kind")
    asked = g.select("gap_id", *scope, kinds, points.alias("p"))
    bucket = lambda x: F.floor(x / F.lit(width)).alias("b")
    m = F.abs("magnitude").cast("long")
    counted = items.where("magnitude is not null").groupBy(*keys, m.alias("v")).agg(F.count("*").alias("one"))  # items of a common size are one row
    pool = counted.select(*keys, bucket(F.col("v")), "v", F.lit(None).cast(gaps.schema["gap_id"].dataType).alias("gap_id"), F.lit(0).alias("sign"), "one")
    marks = asked.select(*keys, bucket(F.col("p.u")), F.col("p.u").alias("v"), "gap_id", "p.sign", F.lit(0).cast("long").alias("one"))
    w = W.partitionBy(*keys, "b").orderBy("v", F.desc("one")).rowsBetween(W.unboundedPreceding, 0)
    both = pool.unionByName(marks).withColumns({"cn": F.sum("one").over(w), "cs": F.sum(F.col("one") * F.col("v")).over(w)})
    totals = pool.groupBy(*keys, "b").agg(F.sum("one").alias("tn"), F.sum(F.col("one") * F.col("v")).alias("ts"))
    all_b = both.where("sign <> 0").select(*keys, "b").distinct().join(totals, [*keys, "b"], "full").fillna(0, ["tn", "ts"])
    before = W.partitionBy(*keys).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    prior = all_b.select(*keys, "b", F.coalesce(F.sum("tn").over(before), F.lit(0)).alias("pn"), F.coalesce(F.sum("ts").over(before), F.lit(0)).alias("ps"))
    seen = both.where("sign <> 0").join(prior, [*keys, "b"])
    ramp = F.col("sign") * (F.col("v") * (F.col("cn") + F.col("pn")) - F.col("cs") - F.col("ps"))
    inside = seen.groupBy("gap_id", *keys).agg(F.sum(ramp).alias("inside"))
    size = items.where("magnitude is not null").groupBy(*keys).agg(F.count("*").alias("size"))
    on = [F.col("g.settlement_id") == F.col("i.item_settlement"), *[F.col(f"g.{c}") == F.col(f"i.{c}") for c in scope]]
    overlap = F.greatest(F.lit(0), F.least(F.col("hi") - 1, m + tolerance) - F.greatest(F.col("lo"), m - tolerance) + 1)
    mine = g.alias("g").join(items.alias("i"), on).groupBy("g.gap_id", "i.kind").agg(F.count("magnitude").alias("own_n"), F.sum(overlap).alias("own"))
    rows = inside.join(size, keys).join(g.select("gap_id", "lo", "hi"), "gap_id").join(mine, ["gap_id", "kind"], "left").fillna(0, ["own_n", "own"])
    rows = rows.withColumn("n", F.col("size") - F.col("own_n")).where("n > 0")
    return rows.select("gap_id", "kind", "n", measured_fits(F.col("inside") - F.col("own"), F.col("lo"), F.col("hi")).alias("expected"))


def level_of(kind: Column) -> Column:
    level = F.lit(None).cast("string")
    for name, of in LEVEL_OF.items():
        level = F.when(kind == name, of).otherwise(level)
    return level


def single_candidates(gaps: DataFrame, items: DataFrame, tolerance: int, scope: list[str] | None = None) -> DataFrame:
    """(gap_id, level, item_id, kind, residual): single items of other settlements that fit a gap, by a bucketed band join."""
    scope = scope or []
    g = gaps.select("gap_id", "settlement_id", *scope, F.abs("delta").alias("target"))
    width = 2 * tolerance + 1
    probe = g.withColumn("__k", F.explode(F.array(*[F.floor(F.col("target") / width) + k for k in (-1, 0, 1)])))
    keyed = items.withColumn("__k", F.floor(F.col("magnitude") / width))
    hits = probe.join(keyed, [*scope, "__k"]).where(F.abs(F.col("target") - F.col("magnitude")) <= tolerance)
    hits = hits.where(~F.col("settlement_id").eqNullSafe(F.col("item_settlement")))
    return hits.select("gap_id", level_of(F.col("kind")).alias("level"), "item_id", "kind", (F.col("target") - F.col("magnitude")).alias("residual"))


def pair_candidates(gaps: DataFrame, items: DataFrame, tolerance: int, scope: list[str] | None = None) -> DataFrame:
    """(gap_id, item_a, item_b, residual), item_a < item_b: unordered pairs of items that sum to a gap.

    The smaller item looks up its complement's bucket: one probe row for each gap and item of the scope, never a
    pair of items that doesn't fit. Run it on the gaps that no single item explains.
    """
    scope = scope or []
    width = 2 * tolerance + 1
    g = gaps.select("gap_id", "settlement_id", *scope, F.abs("delta").alias("target"))
    a = items.select(*scope, F.col("item_id").alias("a"), F.col("magnitude").alias("ma"), F.col("item_settlement").alias("sa"))
    half = (g.join(a, scope) if scope else g.join(a)).where(~F.col("settlement_id").eqNullSafe(F.col("sa")))
    half = half.where(F.col("ma") * 2 <= F.col("target") + tolerance)
    probe = half.withColumn("__k", F.explode(F.array(*[F.floor((F.col("target") - F.col("ma")) / width) + k for k in (-1, 0, 1)])))
    b = items.select(*scope, F.col("item_id").alias("b"), F.col("magnitude").alias("mb"), F.col("item_settlement").alias("sb"), F.floor(F.col("magnitude") / width).alias("__k"))
    hits = probe.join(b, [*scope, "__k"]).where(F.abs(F.col("target") - F.col("ma") - F.col("mb")) <= tolerance)
    hits = hits.where(~F.col("settlement_id").eqNullSafe(F.col("sb")) & (F.col("a") != F.col("b")))
    out = hits.select("gap_id", F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"), (F.col("target") - F.col("ma") - F.col("mb")).alias("residual"))
    return out.distinct()


def _scale(x: Column) -> Column:
    """Bucket of an amount, eight to each doubling: a few hundred at most, whatever the amounts; 0 up to one paisa."""
    return F.floor(8 * F.log2(F.greatest(x, F.lit(1)).cast("double")))


def _amounts_below(gaps: DataFrame, items: DataFrame, upto: Column) -> tuple[DataFrame, DataFrame]:
    """(gaps' rows with each distinct amount m that is at most ``upto`` and the number n of other batches' items of it; the pool).

    An equi-join on buckets of the amount's logarithm: each gap meets the buckets up to its limit's.
    """
    pool = items.where("magnitude is not null").dropDuplicates(["item_id", "magnitude", "item_settlement"])
    total = cut(pool.groupBy(F.col("magnitude").alias("m")).agg(F.count("*").alias("n")).withColumn("__s", _scale(F.col("m"))))
    own = cut(gaps.join(pool, F.col("settlement_id").eqNullSafe(F.col("item_settlement"))).groupBy("gap_id", F.col("magnitude").alias("m")).agg(F.count("*").alias("o")))
    asked = gaps.withColumn("__u", upto).withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), _scale(F.col("__u")))))
    rows = asked.join(total, "__s").where(F.col("m") <= F.col("__u")).drop("__s", "__u")
    rows = rows.join(own, ["gap_id", "m"], "left").withColumn("n", F.col("n") - F.coalesce("o", F.lit(0))).where("n > 0").drop("o")
    return rows, own


def pair_hits(gaps: DataFrame, items: DataFrame, tolerance: int) -> DataFrame:
    """(gap_id, target, settlement_id, ma, mb, pairs): the amounts ma <= mb of which ``pairs`` pairs of items fit a gap.

    Items are counted by magnitude first, less those of the gap's own settlement; a gap then meets each magnitude up to
    half of it once, and that at most the 2 * tolerance + 1 magnitudes that fit it. No pair of items is made.
    """
    width = 2 * tolerance + 1
    g = gaps.select("gap_id", "settlement_id", F.abs("delta").alias("target"))
    half, own = _amounts_below(g, items, F.floor((F.col("target") + tolerance) / 2))
    half = half.withColumnsRenamed({"m": "ma", "n": "na"})
    probe = half.withColumn("__k", F.explode(F.array(*[F.floor((F.col("target") - F.col("ma")) / width) + k for k in (-1, 0, 1)])))
    total = items.where("magnitude is not null").dropDuplicates(["item_id", "magnitude", "item_settlement"]).groupBy(F.col("magnitude").alias("mb")).agg(F.count("*").alias("nb"))
    hits = probe.join(total.withColumn("__k", F.floor(F.col("mb") / width)), "__k")
    hits = hits.where((F.abs(F.col("target") - F.col("ma") - F.col("mb")) <= tolerance) & (F.col("ma") <= F.col("mb")))
    hits = hits.join(own.withColumnRenamed("m", "mb"), ["gap_id", "mb"], "left").withColumn("nb", F.col("nb") - F.coalesce("o", F.lit(0)))
    pairs = F.when(F.col("ma") == F.col("mb"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    return hits.withColumn("pairs", pairs).where("pairs > 0").select("gap_id", "target", "settlement_id", "ma", "mb", "pairs")


def pair_counts(gaps: DataFrame, items: DataFrame, tolerance: int) -> DataFrame:
    """(gap_id, n_candidates, ma, mb): how many pairs ``pair_candidates`` finds for each gap with any, and the amounts of one."""
    found = pair_hits(gaps, items, tolerance).groupBy("gap_id").agg(F.sum("pairs").cast("long").alias("n_candidates"), F.min(F.struct("ma", "mb")).alias("p"))
    return found.select("gap_id", "n_candidates", "p.ma", "p.mb")


#: Candidates of a gap that a finding shows (fixed value).
SHOWN = 6


def _small_enough(gaps: DataFrame, items: DataFrame, tolerance: int) -> DataFrame:
    """Items that can be in a gap, alone or with another: none is larger than the largest gap, unless the other is below zero."""
    top = gaps.agg(F.max(F.abs("delta"))).first()[0] or 0
    small = cut(items.where(F.col("magnitude") <= top + tolerance))
    least = small.agg(F.min("magnitude")).first()[0] or 0
    return small if least >= 0 else cut(items.where(F.col("magnitude") <= top + tolerance - least))


def nearest_singles(gaps: DataFrame, items: DataFrame, tolerance: int, keep: int) -> DataFrame:
    """(gap_id, level, item_id, kind, magnitude, residual, declared): of ``single_candidates`` the first ``keep`` of each gap's first level.

    Gaps of one size have the same candidates but for those of their own settlement. So each size is looked up once, for ``keep``
    items of a level and as many more as any of its settlements has itself; no gap meets all items that fit it.
    """
    residual = F.col("target") - F.col("magnitude")
    fits = F.abs(residual) <= tolerance
    pool = items.select("item_id", "kind", level_of(F.col("kind")).alias("level"), "magnitude", F.col("item_settlement").alias("declared")).where("level is not null and magnitude is not null")
    g = gaps.select("gap_id", "settlement_id", F.abs("delta").alias("target"))
    asked = cut(g.select("settlement_id", "target").distinct())
    own = asked.join(pool, F.col("settlement_id").eqNullSafe(F.col("declared"))).where(fits).groupBy("settlement_id", "target", "level").agg(F.count("*").alias("own"))
    own = cut(own)
    most = own.groupBy("target", "level").agg(F.max("own").alias("most"))
    deepest = keep + (own.agg(F.max("own")).first()[0] or 0)
    width = 2 * tolerance + 1
    probe = asked.select("target").distinct().withColumn("__k", F.explode(F.array(*[F.floor(F.col("target") / width) + k for k in (-1, 0, 1)])))
    amounts = pool.groupBy("level", "magnitude").agg(F.count("*").alias("n")).withColumn("__k", F.floor(F.col("magnitude") / width))
    near = probe.join(amounts, "__k").where(fits).join(most, ["target", "level"], "left").withColumn("depth", keep + F.coalesce("most", F.lit(0)))
    nearer = F.sum("n").over(W.partitionBy("target", "level").orderBy(F.abs(residual)).rangeBetween(W.unboundedPreceding, -1))
    chosen = near.withColumn("nearer", F.coalesce(nearer, F.lit(0))).where("nearer < depth").select("target", "level", "magnitude", "depth")
    first = pool.withColumn("nth", F.row_number().over(W.partitionBy("level", "magnitude").orderBy("item_id"))).where(F.col("nth") <= deepest)
    row = F.struct(F.abs(residual).alias("away"), "item_id", "kind", "magnitude", residual.alias("residual"), "declared")
    lists = chosen.join(first, ["level", "magnitude"]).where("nth <= depth").groupBy("target", "level").agg(F.array_sort(F.collect_list(row)).alias("list"))  # some depth * depth at most
    a, o = asked.join(lists, "target").alias("a"), own.alias("o")
    same = F.col("a.settlement_id").eqNullSafe(F.col("o.settlement_id")) & (F.col("a.target") == F.col("o.target")) & (F.col("a.level") == F.col("o.level"))
    shown = F.explode(F.slice("a.list", F.lit(1), (keep + F.coalesce("o.own", F.lit(0))).cast("int"))).alias("c")
    told = a.join(o, same, "left").select("a.settlement_id", "a.target", "a.level", shown).where(~F.col("settlement_id").eqNullSafe(F.col("c.declared")))
    w = W.partitionBy("settlement_id", "target")
    told = told.withColumn("lowest", F.min("level").over(w)).where("level = lowest").withColumn("nth", F.row_number().over(w.orderBy("c.away", "c.item_id"))).where(F.col("nth") <= keep).alias("t")
    back = F.col("g.settlement_id").eqNullSafe(F.col("t.settlement_id")) & (F.col("g.target") == F.col("t.target"))
    return g.alias("g").join(told, back).select("gap_id", "level", "c.item_id", "c.kind", "c.magnitude", "c.residual", "c.declared")


def shown_candidates(gaps: DataFrame, items: DataFrame, tolerance: int = C.NET_TOLERANCE, keep: int = SHOWN) -> DataFrame:
    """(gap_id, level, candidates): the first ``keep`` candidates of each gap's level, smallest residual first, then by id.

    candidates: item_id (a pair's ids in order, with a plus between), kind, magnitude, residual, declared: the settlement
    that the item's own record names, a pair's only if both name it. Pairs are taken by their amounts first, so
    of an amount that thousands of items share only the ``keep`` smallest ids are looked up, one more for pairs of equal amounts.
    """
    open_ = cut(gaps.where(F.abs("delta") > tolerance).select("gap_id", "settlement_id", "delta"))
    items = _small_enough(open_, items, tolerance)
    one = cut(nearest_singles(open_, items, tolerance, keep))
    rest = cut(open_.join(one.select("gap_id"), "gap_id", "left_anti"))
    residual = F.col("target") - F.col("ma") - F.col("mb")
    few = pair_hits(rest, items, tolerance).withColumn("nth", F.row_number().over(W.partitionBy("gap_id").orderBy(F.abs(residual), "ma"))).where(F.col("nth") <= keep).drop("nth")
    few = cut(few)
    sides = few.select("gap_id", "settlement_id", F.explode(F.array_distinct(F.array("ma", "mb"))).alias("magnitude")).distinct()
    found = sides.join(items.select("item_id", "magnitude", "item_settlement").distinct(), "magnitude").where(~F.col("settlement_id").eqNullSafe(F.col("item_settlement")))
    found = found.withColumn("nth", F.row_number().over(W.partitionBy("gap_id", "magnitude").orderBy("item_id"))).where(F.col("nth") <= keep + 1)
    own = found.groupBy("gap_id", "magnitude").agg(F.array_sort(F.collect_list(F.struct("item_id", "item_settlement"))).alias("ids"))  # keep + 1 at most
    left, right = (own.withColumnsRenamed({"magnitude": m, "ids": i}) for m, i in (("ma", "a"), ("mb", "b")))
    met = few.join(left, ["gap_id", "ma"]).join(right, ["gap_id", "mb"]).withColumn("x", F.explode("a")).withColumn("y", F.explode("b"))
    met = met.where((F.col("ma") < F.col("mb")) | (F.col("x.item_id") < F.col("y.item_id")))
    lo, hi = F.least("x.item_id", "y.item_id"), F.greatest("x.item_id", "y.item_id")
    declared = F.when(F.col("x.item_settlement") == F.col("y.item_settlement"), F.col("x.item_settlement"))
    two = met.select("gap_id", F.lit("L4").alias("level"), F.concat_ws("+", lo, hi).alias("item_id"), F.lit("pair").alias("kind"), (F.col("ma") + F.col("mb")).alias("magnitude"), residual.alias("residual"), declared.alias("declared"))
    both = one.unionByName(two).withColumn("nth", F.row_number().over(W.partitionBy("gap_id").orderBy(F.abs("residual"), "item_id"))).where(F.col("nth") <= keep)
    row = F.struct("nth", F.struct("item_id", "kind", "magnitude", "residual", "declared").alias("c"))
    rows = both.groupBy("gap_id").agg(F.min("level").alias("level"), F.array_sort(F.collect_list(row)).alias("rows"))  # keep rows at most
    return rows.select("gap_id", "level", F.transform("rows", lambda r: r["c"]).alias("candidates"))


def only_pair(gaps: DataFrame, counts: DataFrame, items: DataFrame) -> DataFrame:
    """(gap_id, item_id): the two items of each gap whose pair is the only one, looked up by their amounts."""
    one = counts.where("n_candidates = 1").join(gaps.select("gap_id", "settlement_id"), "gap_id")
    sides = one.select("gap_id", "settlement_id", F.explode(F.array_distinct(F.array("ma", "mb"))).alias("magnitude"))
    found = sides.join(items, "magnitude").where(~F.col("settlement_id").eqNullSafe(F.col("item_settlement")))
    return found.groupBy("gap_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), "+").alias("item_id"))


def pair_chance(gaps: DataFrame, items: DataFrame, tolerance: int, width: int = 1 << 20) -> DataFrame:
    """(gap_id, chance): the exact mean number of pairs of other batches' items that fit a target drawn as in ``single_fits``; for gaps that are few.

    As in ``single_fits`` it is a difference of four sums of u - s over the pair sums s below u. For each amount a of
    the pool they are the sums of (u - a) - b over the amounts b below u - a, read off running counts and sums.
    """
    t = F.abs("delta")
    low = F.greatest(F.lit(1), F.floor(t / 2))
    g = gaps.select("gap_id", "settlement_id", low.alias("lo"), F.greatest(low + 1, F.floor(t * 3 / 2)).alias("hi"))
    pool = cut(_amounts_below(g, items, F.col("hi") + tolerance)[0].select("gap_id", "lo", "hi", "m", "n"))
    ends = [(1, F.col("hi") + tolerance), (-1, F.col("hi") - 1 - tolerance), (-1, F.col("lo") + tolerance), (1, F.col("lo") - 1 - tolerance)]
    points = F.explode(F.array(*[F.struct((F.lit(sign) * F.col("n")).cast("long").alias("w"), (u - F.col("m")).cast("long").alias("v")) for sign, u in ends])).alias("p")
    marks = pool.select("gap_id", points).where("p.v > 0").select("gap_id", "p.v", F.lit(0).cast("long").alias("n"), "p.w")
    both = pool.select("gap_id", F.col("m").cast("long").alias("v"), "n", F.lit(0).cast("long").alias("w")).unionByName(marks).withColumn("b", F.floor(F.col("v") / F.lit(width)))
    run = W.partitionBy("gap_id", "b").orderBy("v", F.desc("n")).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("gap_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    prior = both.groupBy("gap_id", "b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"))
    prior = prior.select("gap_id", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pn"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ps"))
    seen = both.withColumns({"cn": F.sum("n").over(run), "cs": F.sum(F.col("n") * F.col("v")).over(run)}).where("w <> 0").join(prior, ["gap_id", "b"])
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of three longs
    ramp = wide(F.col("w")) * (wide(F.col("v")) * wide(F.col("cn") + F.col("pn")) - wide(F.col("cs") + F.col("ps"))).cast("decimal(38,0)")
    total = seen.groupBy("gap_id").agg(F.sum(ramp.cast("decimal(38,0)")).cast("double").alias("total"))
    twice = 2 * F.col("m")
    itself = F.col("n") * F.greatest(F.lit(0), F.least(F.col("hi") - 1, twice + tolerance) - F.greatest(F.col("lo"), twice - tolerance) + 1)
    rows = pool.groupBy("gap_id", "lo", "hi").agg(F.sum(itself).alias("itself")).join(total, "gap_id", "left")
    return rows.select("gap_id", ((F.coalesce("total", F.lit(0.0)) - F.col("itself")) / 2 / (F.col("hi") - F.col("lo"))).alias("chance"))


def first_singles(gaps: DataFrame, items: DataFrame, tolerance: int) -> DataFrame:
    """(gap_id, level, kind, n_candidates, item_id): of each gap that any single item fits the first level with one."""
    singles = single_candidates(gaps, items, tolerance)
    first = singles.groupBy("gap_id", "level", "kind").agg(F.count("*").alias("n_candidates"), F.min("item_id").alias("item_id"))
    return cut(first.withColumn("rank", F.row_number().over(W.partitionBy("gap_id").orderBy("level"))).where("rank = 1").drop("rank"))


def lone_pairs(gaps: DataFrame, counts: DataFrame, items: DataFrame, tolerance: int) -> DataFrame:
    """(gap_id, item_id, chance): gaps that one pair alone fits, with its items and the exact chance of a pair."""
    alone = cut(gaps.join(counts.where("n_candidates = 1"), "gap_id", "left_semi"))
    if alone.isEmpty():
        return alone.select("gap_id", F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("double").alias("chance"))
    return only_pair(alone, counts, items).join(pair_chance(alone, items, tolerance), "gap_id")


def by_pairs(rest: DataFrame, items: DataFrame, tolerance: int) -> DataFrame:
    """(gap_id, n_candidates, item_id, expected) of gaps that pairs of items fit: the only pair with its chance, several with a floor."""
    counts = cut(pair_counts(rest, items, tolerance))
    floors = F.broadcast(chance_floors(items, tolerance).table(rest.sparkSession))
    several = counts.where("n_candidates > 1").join(rest, "gap_id").withColumn("cell", cell_of(F.abs("delta"))).join(floors, "cell", "left")
    several = several.select("gap_id", "n_candidates", F.lit(None).cast("string").alias("item_id"), F.coalesce("at_least", F.lit(0.0)).alias("expected"))
    return lone_pairs(rest, counts, items, tolerance).select("gap_id", F.lit(1).cast("long").alias("n_candidates"), "item_id", F.col("chance").alias("expected")).unionByName(several)


def attribute(gaps: DataFrame, items: DataFrame, tolerance: int = C.NET_TOLERANCE) -> DataFrame:
    """(gap_id, level, outcome, item_id, n_candidates, expected, band, confidence) for each gap (gap_id, settlement_id, delta).

    The first level with a candidate decides: one is the cause unless chance explains it as well, several are
    ambiguous. Pairs are looked for only where no single item fits: they are counted exactly for every gap. Where the
    count is one, which alone depends on it, the chance is exact; where several pairs fit, ``expected`` is a floor, as many as
    there surely are by chance.
    """
    open_ = gaps.where(F.abs("delta") > tolerance)
    first = first_singles(open_, items, tolerance)
    fits = single_fits(open_.join(first.select("gap_id"), "gap_id", "left_semi"), items, tolerance)
    one = first.join(fits.select("gap_id", "kind", "expected"), ["gap_id", "kind"], "left").withColumn("base", F.lit(C.CONFIDENCE["single"]))
    rest = cut(open_.join(first.select("gap_id"), "gap_id", "left_anti").select("gap_id", "settlement_id", "delta"))
    two = by_pairs(rest, items, tolerance) if not rest.isEmpty() else rest.select("gap_id", *[F.lit(None).cast(t).alias(c) for c, t in (("n_candidates", "long"), ("item_id", "string"), ("expected", "double"))])
    two = two.withColumns({"level": F.lit("L4"), "kind": F.lit("pair"), "base": F.lit(C.CONFIDENCE["pair"])})
    found = one.unionByName(two.select(*one.columns))
    rows = gaps.select("gap_id", "settlement_id", "delta").join(found, "gap_id", "left").withColumn("band", band(F.col("expected")))
    small, none = F.abs("delta") <= tolerance, F.col("level").isNull()
    outcome = (
        F.when(small, "ROUNDING_DRIFT_ACCEPTED").when(none, "AMOUNT_VARIANCE_UNEXPLAINED").when(F.col("n_candidates") > 1, "AMBIGUOUS_MULTI_CANDIDATE")
        .when(F.col("band") == "REFUSE", "AMOUNT_VARIANCE_UNEXPLAINED").otherwise("ATTRIBUTED")
    )
    rows = rows.withColumn("outcome", outcome)
    conf = F.when(small, C.CONFIDENCE["rounding"]).when(F.col("outcome") == "ATTRIBUTED", F.col("base")).otherwise(0.0)
    count = F.when(small | none, 0).otherwise(F.col("n_candidates")).cast("long")
    return rows.select("gap_id", "settlement_id", "delta", F.when(small, "L0").when(none, "L5").otherwise(F.col("level")).alias("level"), "outcome", F.when(F.col("outcome") == "ATTRIBUTED", F.col("item_id")).alias("item_id"), count.alias("n_candidates"), "expected", F.when(~none, F.col("band")).alias("band"), conf.alias("confidence"))
