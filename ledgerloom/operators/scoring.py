"""Decisions against the truth, and statistics over runs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_decision(decisions: DataFrame, key: str, order: str) -> DataFrame:
    """The first decision of each key, with how many more there were."""
    w = W.partitionBy(key)
    rows = decisions.withColumn("__n", F.row_number().over(w.orderBy(order))).withColumn("duplicates", F.count("*").over(w) - 1)
    return rows.where("__n = 1").drop("__n")


def same_items(claimed: Column, true: Column) -> Column:
    """Whether two lists hold the same items; an empty claim asserts nothing and passes."""
    a, b = F.array_sort(F.array_distinct(F.coalesce(claimed, F.array()))), F.array_sort(F.array_distinct(F.coalesce(true, F.array())))
    return (F.size(a) == 0) | (a == b)


def score(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: claims, coverage, precision, recall, exception accuracy; a ratio without cases is null.

    decisions: order_id, outcome; truth: order_id, expected.
    """
    rows = truth.join(decisions.select("order_id", "outcome"), "order_id", "left")
    matched, should = F.col("outcome") == "MATCHED", F.col("expected") == "MATCHED"
    right = F.count_if(matched & should)
    return rows.agg(
        F.count("*").alias("orders"), F.count_if(matched).alias("claims"), right.alias("right_claims"),
        F.try_divide(F.count_if(matched), F.count("*")).alias("coverage"), F.try_divide(right, F.count_if(matched)).alias("precision"),
        F.try_divide(right, F.count_if(should)).alias("recall"),
        F.try_divide(F.count_if(~should & F.col("outcome").eqNullSafe(F.col("expected"))), F.count_if(~should)).alias("exception_accuracy"),
    )


def confusion(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    rows = truth.join(decisions.select("order_id", "outcome"), "order_id", "left")
    return rows.groupBy("expected", "outcome").agg(F.count("*").alias("n"))


def run_statistics(runs: DataFrame, metric: str, name: str) -> DataFrame:
    """min, max, mean and population deviation of a metric over runs, with the run that has the least."""
    return runs.agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"), F.min_by(name, metric).alias("worst"))


def checks(df: DataFrame, section: str, conditions: dict[str, Column]) -> DataFrame:
    """(section, check, passed, failures): each condition over all rows, in one pass."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("failures")) for k in conditions]))
    return one.select(F.lit(section).alias("section"), rows.alias("r")).select("section", "r.check", (F.col("r.failures") == 0).alias("passed"), "r.failures")


def counts_of(df: DataFrame, column: str, values: tuple[str, ...], out: str = "n") -> DataFrame:
    """(column, n): one row for each of ``values``, with zero for those that ``df`` doesn't have."""
    all_ = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    own = df.groupBy(column).agg(F.count("*").alias(out))
    return all_.join(own, column, "left").fillna(0, [out])


def tolerance_curve(pairs: DataFrame, key: str, delta: str, tolerances: tuple[int, ...]) -> DataFrame:
    """(tolerance, candidates, keys, ambiguous): what each tolerance would admit, and how many keys have more than one.

    Each pair counts at its own least tolerance; a key's running counts over the tolerances, one row for each (key,
    tolerance), take the place of a join of the pairs with every tolerance.
    """
    steps = F.array(*map(F.lit, sorted(tolerances)))
    least = F.array_min(F.filter(steps, lambda t: t >= F.abs(F.col(delta))))
    own = pairs.select(key, least.alias("t")).where("t is not null").groupBy(key, "t").agg(F.count("*").alias("n"))
    running = own.withColumn("upto", F.sum("n").over(W.partitionBy(key).orderBy("t").rowsBetween(W.unboundedPreceding, 0)))
    first = F.col("upto") == F.col("n")
    turned = (F.col("upto") > 1) & (F.col("upto") - F.col("n") <= 1)
    per = running.groupBy("t").agg(F.sum("n").alias("c"), F.count_if(first).alias("k"), F.count_if(turned).alias("a"))
    all_ = pairs.sparkSession.createDataFrame([(t,) for t in tolerances], "tolerance long")
    rows = all_.join(per, F.col("tolerance") == F.col("t"), "left").fillna(0, ["c", "k", "a"])
    w = W.orderBy("tolerance").rowsBetween(W.unboundedPreceding, 0)  # a row for each tolerance
    return rows.select("tolerance", F.sum("c").over(w).alias("candidates"), F.sum("k").over(w).alias("keys"), F.sum("a").over(w).alias("ambiguous"))


def rate_checks(observed: DataFrame, rates: dict[str, float], z: float = 4.0) -> DataFrame:
    """(name, observed, n, passed): whether each count is within z deviations, and one more, of its rate's binomial mean.

    ``observed``: name, observed, n. A name without a rate isn't checked; n of 0 passes.
    """
    spark = observed.sparkSession
    rows = observed.join(F.broadcast(spark.createDataFrame(list(rates.items()), "name string, p double")), "name")
    sd = F.sqrt(F.greatest(F.col("n") * F.col("p") * (1 - F.col("p")), F.lit(1e-9)))
    return rows.select("name", "observed", "n", ((F.col("n") == 0) | (F.abs(F.col("observed") - F.col("n") * F.col("p")) <= z * sd + 1)).alias("passed"))


def carry_chain(cycles: DataFrame, partition: list[str], order: Column, carry_in: str, carry_out: str) -> DataFrame:
    """(partition, links, broken): of each chain in order, how many cycles hand on, and how many of these not what the next takes in."""
    w = W.partitionBy(*partition).orderBy(order)
    rows = cycles.withColumn("__next", F.lead(carry_in).over(w)).where("__next is not null")
    return rows.groupBy(*partition).agg(F.count("*").alias("links"), F.count_if(F.col(carry_out) != F.col("__next")).alias("broken"))


def bank_score(dispositions: DataFrame, orphans: DataFrame, payouts: DataFrame) -> DataFrame:
    """One row of how bank rows were judged: orphans found of all, and noise flagged of all noise, with both ratios.

    ``dispositions``: bank_row_id, disposition. Noise is every judged row that is neither an orphan nor a payout's.
    """
    own = dispositions.select("bank_row_id", "disposition")
    ids = lambda df, name: df.select("bank_row_id", F.lit(True).alias(name)).distinct()
    rows = own.join(ids(orphans, "orphan"), "bank_row_id", "full").join(ids(payouts, "payout"), "bank_row_id", "left")
    orphan, found = F.col("orphan").isNotNull(), F.col("disposition") == "MISSING_IN_GATEWAY"
    noise = F.col("disposition").isNotNull() & ~orphan & F.col("payout").isNull()
    flagged = noise & (F.col("disposition") != "IGNORED")
    return rows.agg(
        F.count("disposition").alias("judged"), F.count_if(orphan).alias("orphans"), F.count_if(orphan & found).alias("orphans_found"), F.count_if(noise).alias("noise"), F.count_if(flagged).alias("noise_flagged"),
        F.try_divide(F.count_if(orphan & found), F.count_if(orphan)).alias("orphan_recall"), F.try_divide(F.count_if(flagged), F.count_if(noise)).alias("noise_flag_rate"),
    )


def attribution_score(attributions: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """(by, claims, right): claimed causes, items joined by "+", that name the same items as the truth (gap_id, items array)."""
    rows = attributions.where("item_id is not null").join(truth, "gap_id", "left")
    right = same_items(F.split("item_id", r"\+"), F.col("items")) & F.col("items").isNotNull()
    return rows.groupBy(by).agg(F.count("*").alias("claims"), F.count_if(right).alias("right"))


def held_out_gap(measures: DataFrame) -> DataFrame:
    """(metric, dev, held_out, gap) of measures (metric, part, value) whose part is "dev" or "held_out"."""
    one = lambda part: measures.where(F.col("part") == part).select("metric", F.col("value").alias(part))
    return one("dev").join(one("held_out"), "metric").withColumn("gap", F.col("held_out") - F.col("dev"))


def run_curves(pairs: DataFrame, totals: DataFrame, run: str, key: str, delta: str, tolerances: tuple[int, ...]) -> DataFrame:
    """(run, tolerance, answered, wrong, precision, coverage) of the keys of each run that each tolerance answers.

    ``pairs``: run, key, delta; ``totals``: run, total. A key with several candidates is answered wrongly; precision
    is null where nothing is answered.
    """
    steps = F.array(*[F.lit(t).cast("long") for t in sorted(tolerances)])
    within = F.explode(F.filter(steps, lambda t: t >= F.abs(F.col(delta)))).alias("tolerance")
    keys = pairs.select(run, key, within).groupBy(run, "tolerance", key).agg(F.count("*").alias("n"))
    per = keys.groupBy(run, "tolerance").agg(F.count("*").alias("answered"), F.count_if(F.col("n") > 1).alias("wrong"))
    rows = totals.select(run, "total", F.explode(steps).alias("tolerance")).join(per, [run, "tolerance"], "left").fillna(0, ["answered", "wrong"])
    return rows.select(run, "tolerance", "answered", "wrong", F.try_divide(F.col("answered") - F.col("wrong"), F.col("answered")).alias("precision"), F.try_divide("answered", "total").alias("coverage"))


def curve_limits(curves: DataFrame, run: str) -> DataFrame:
    """(run, first_loss, first_coverage_move): the least tolerance with a wrong answer, and the least whose coverage isn't that of the smallest; null where there is none."""
    rows = curves.withColumn("__base", F.min_by("coverage", "tolerance").over(W.partitionBy(run)))
    return rows.groupBy(run).agg(F.min(F.when(F.col("precision") < 1, F.col("tolerance"))).alias("first_loss"), F.min(F.when(~F.col("coverage").eqNullSafe(F.col("__base")), F.col("tolerance"))).alias("first_coverage_move"))


def curve_grid(curves: DataFrame) -> DataFrame:
    """(tolerance, least_precision, mean_coverage, wrong, exact) over all runs; exact where every run answers, and rightly."""
    exact = F.bool_and(F.coalesce(F.col("precision") == 1, F.lit(False))).alias("exact")
    return curves.groupBy("tolerance").agg(F.min("precision").alias("least_precision"), F.avg("coverage").alias("mean_coverage"), F.sum("wrong").alias("wrong"), exact)


def exact_through(grid: DataFrame) -> DataFrame:
    """One row: the largest tolerance that is exact in every run (null: none), and the smallest at which one loses."""
    return grid.agg(F.max(F.when(F.col("exact"), F.col("tolerance"))).alias("exact_through"), F.min(F.when(F.col("least_precision") < 1, F.col("tolerance"))).alias("earliest_loss"))


#: Accuracy below which the strongest band isn't honest (fixed value).
STRONG_FLOOR = 0.98


def beta_below(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_below(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for k in range(400):
        m = k // 2
        t = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d or 1e-300)
        c = 1 + t / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def exact_interval(right: int, n: int, miss: float = 0.05) -> tuple[float, float]:
    """The exact binomial interval (Clopper and Pearson) of a rate of which ``right`` of ``n`` were seen."""

    def where(level: float, a: float, b: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if beta_below(mid, a, b) < level else (lo, mid)
        return (lo + hi) / 2

    return 0.0 if right == 0 else where(miss / 2, right, n - right + 1), 1.0 if right == n else where(1 - miss / 2, right + 1, n - right)


def calibration(attributions: DataFrame, truth: DataFrame, miss: float = 0.05, floor: float = STRONG_FLOOR) -> DataFrame:
    """(band, claims, right, wrong, accuracy, low, high, honest) over all runs: how often each band's named causes are the true ones.

    attributions: run, settlement_id, item_id (a pair's joined by "+", null: no cause named), band; truth: run, settlement_id,
    items. A cause without a truth is wrong. The interval is exact; ``honest``, for the strongest band, says whether the
    accuracy reaches ``floor``, and is null for the others and where nothing was claimed.
    """

    @F.pandas_udf("low double, high double")
    def interval(right: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([exact_interval(int(r), int(k), miss) for r, k in zip(right, n, strict=True)], columns=["low", "high"])

    rows = attributions.where("item_id is not null and band is not null").join(truth, ["run", "settlement_id"], "left")
    right = F.coalesce((F.size("items") > 0) & same_items(F.split("item_id", r"\+"), F.col("items")), F.lit(False))
    own = rows.groupBy("band").agg(F.count("*").alias("claims"), F.count_if(right).alias("right"))  # a row for each band
    own = own.withColumn("i", interval("right", "claims")).withColumn("accuracy", F.col("right") / F.col("claims"))
    honest = F.when(F.col("band") == "STRONG", F.col("accuracy") >= floor)
    return own.select("band", "claims", "right", (F.col("claims") - F.col("right")).alias("wrong"), "accuracy", "i.low", "i.high", honest.alias("honest"))


def calibration_runs(attributions: DataFrame, truth: DataFrame) -> DataFrame:
    """(run, gaps, claims, refused) of each run: how many gaps its truth has, causes it names, and bands it refuses on."""
    named = F.count_if(F.col("item_id").isNotNull() & F.col("band").isNotNull())
    own = attributions.groupBy("run").agg(named.alias("claims"), F.count_if(F.col("band") == "REFUSE").alias("refused"))
    return truth.groupBy("run").agg(F.count("*").alias("gaps")).join(own, "run", "full").fillna(0, ["gaps", "claims", "refused"])
