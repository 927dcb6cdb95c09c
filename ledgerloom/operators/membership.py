"""Which payments a credit without a payout is made of, and how much a combination that fits is worth.

A pool is the payments that were due within the posting window of a credit and are no larger than it. Pools are
sized before they are listed: running counts over each due day's sorted payments give every credit's pool size, sum and sum of
squares without a row for each of its payments. Pools with more subsets than can be searched are answered from these alone.
The others hold few payments, so only each day's smallest ones are ever joined to credits.

Each searched pool is met in the middle. The same two halves count exactly how many subsets come near the credit,
which says how many would fit by chance: where that is one or more, a fit proves nothing and the credit is refused.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.calendar import add_business_days, capture_day
from ledgerloom.operators.batches import net_contribution
from ledgerloom.operators.ranking import numbered
from ledgerloom.sources.checkpoints import cut

#: Subsets of both halves that one search may hold, and solutions that are kept (fixed values).
CAP, KEEP = 500_000, 8
#: A pool's sum is divided into this many stretches; the density of subsets is read off the one around the target (fixed value).
STRETCHES = 60
#: Pools of up to this many payments are searched together, so many subsets in one array.
AT_ONCE, CELLS = 10, 1 << 18


def largest_pool(cap: int = CAP) -> int:
    """The most payments whose two halves have at most ``cap`` subsets together."""
    n = 0
    while (1 << ((n + 1) // 2)) + (1 << (n + 1 - (n + 1) // 2)) <= cap:
        n += 1
    return n


def due_payments(payments: DataFrame, calendar: DataFrame, lag_days: int, cutoff_hour: int, withholding_bps: int) -> DataFrame:
    """payment_id, amount_paise, fee_paise, tax_paise, due (the day its cycle settles) and contribution, what it adds to a payout."""
    rows = add_business_days(payments.withColumn("__c", capture_day(F.col("ts"), cutoff_hour)), calendar, "__c", lag_days, "due")
    own = net_contribution(F.col("amount_paise"), F.col("fee_paise"), F.col("tax_paise"), withholding_bps)
    return rows.select("payment_id", "amount_paise", "fee_paise", "tax_paise", "due", own.cast("long").alias("contribution"))


def due_days(credits: DataFrame, payments: DataFrame, calendar: DataFrame, window: int, tolerance: int) -> DataFrame:
    """(bank_row_id, due, most): each credit with the days whose payments can be in it, and the largest contribution that can."""
    days = add_business_days(payments.select("due").where("due is not null").distinct(), calendar, "due", window, "until")  # as many rows as the calendar has days
    open_ = days.select("due", F.explode(F.sequence("due", "until")).alias("event_date"))
    return credits.select("bank_row_id", "event_date", (F.col("credit_paise") + tolerance).alias("most")).join(F.broadcast(open_), "event_date").select("bank_row_id", "due", "most")


def pool_sizes(days: DataFrame, payments: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(bank_row_id, pool_size, total, squares) of ``due_days``: counts of net amounts (before withholding) by running sums.

    Within buckets of ``width`` paise of a day by a window over both credits and distinct amounts, before them from
    the buckets' totals; credits without any payment are not among the rows.
    """
    net = F.col("amount_paise") - F.col("fee_paise") - F.col("tax_paise")
    bucket = lambda x: F.floor(x / width)
    pool = payments.where("due is not null").groupBy("due", F.col("contribution").alias("v")).agg(F.count("*").alias("n"), F.sum(net.cast("double")).alias("s"), F.sum(net.cast("double") * net).alias("q"))
    pool = cut(pool.withColumn("b", bucket(F.col("v"))))
    zero = [F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")]
    marks = days.select("due", F.col("most").alias("v"), *zero, bucket(F.col("most")).alias("b"), "bank_row_id")
    both = pool.withColumn("bank_row_id", F.lit(None).cast(days.schema["bank_row_id"].dataType)).unionByName(marks)
    run = W.partitionBy("due", "b").orderBy("v", F.desc("n")).rowsBetween(W.unboundedPreceding, 0)
    inside = both.select("due", "b", "bank_row_id", *[F.sum(c).over(run).alias(c) for c in "nsq"]).where("bank_row_id is not null")
    totals = pool.groupBy("due", "b").agg(*[F.sum(c).alias(c) for c in "nsq"])
    asked = marks.select("due", "b").distinct().join(totals, ["due", "b"], "full").fillna(0, list("nsq"))
    before = W.partitionBy("due").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    prior = asked.select("due", "b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"p{c}") for c in "nsq"])
    seen = inside.join(prior, ["due", "b"])
    sums = seen.groupBy("bank_row_id").agg(F.sum(F.col("n") + F.col("pn")).alias("pool_size"), F.sum(F.col("s") + F.col("ps")).alias("total"), F.sum(F.col("q") + F.col("pq")).alias("squares"))
    return sums.where("pool_size > 0")


def small_pools(days: DataFrame, sizes: DataFrame, payments: DataFrame, most: int) -> DataFrame:
    """(bank_row_id, payment_id, amount_paise, fee_paise, tax_paise) of pools of at most ``most`` payments.

    None of them has more than a day's ``most`` smallest payments, so only these meet the credits of their day.
    """
    first = W.partitionBy("due").orderBy("contribution", "payment_id")
    low = payments.where("due is not null").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most).drop("nth")
    few = days.join(sizes.where(F.col("pool_size") <= most).select("bank_row_id"), "bank_row_id", "left_semi")
    return few.join(low, "due").where(F.col("contribution") <= F.col("most")).select("bank_row_id", "payment_id", "amount_paise", "fee_paise", "tax_paise")


class Halves:
    """All subsets of a pool, as two sorted halves: of gross amounts and of nets before withholding."""

    def __init__(self, gross: np.ndarray, net: np.ndarray):
        self.n, self.half = len(net), len(net) // 2
        self.left, self.right = self._sums(gross[: self.half], net[: self.half]), self._sums(gross[self.half :], net[self.half :])
        self.total = int(net.sum())

    @staticmethod
    def _sums(gross: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, n = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for a, b in zip(gross, net, strict=True):
            g, n = np.concatenate([g, g + a]), np.concatenate([n, n + b])
        return g, n

    def between(self, lo: int, hi: int) -> int:
        """How many subsets have a net of ``lo`` to ``hi``."""
        ordered = np.sort(self.right[1])
        return int((np.searchsorted(ordered, hi - self.left[1], side="right") - np.searchsorted(ordered, lo - self.left[1], side="left")).sum())

    def chance(self, target: int, tolerance: int) -> float:
        """Subsets that fit a target by chance: their exact density around it times the values that fit."""
        if self.total <= 0:
            return math.inf
        width = max(1, self.total // STRETCHES)
        lo, hi = target - width // 2, target + width // 2
        return self.between(lo, hi) * (2 * tolerance + 1) / (hi - lo + 1)

    def solutions(self, credit: int, withholding_bps: int, tolerance: int, keep: int) -> tuple[int, list[list[int]]]:
        """How many subsets pay out the credit, withheld once on their gross, and the members of the first ``keep``."""
        bps = lambda x: np.sign(x) * ((np.abs(x) * withholding_bps + 5000) // 10000)
        (gl, nl), (gr, nr) = self.left, self.right
        kl, kr = nl - bps(gl), nr - bps(gr)
        order = np.argsort(kr, kind="stable")
        lo = np.searchsorted(kr[order], credit - kl - tolerance - 4, side="left")
        hi = np.searchsorted(kr[order], credit - kl + tolerance + 4, side="right")
        found, kept = 0, []
        for left in np.flatnonzero(hi > lo):
            right = order[lo[left] : hi[left]]
            g, n = gl[left] + gr[right], nl[left] + nr[right]
            ok = (np.abs(credit - (n - bps(g))) <= tolerance) & ((left > 0) | (right > 0))
            for r in right[ok]:
                found += 1
                if len(kept) < keep:
                    kept.append([i for i in range(self.half) if left >> i & 1] + [self.half + i for i in range(self.n - self.half) if r >> i & 1])
        return found, kept


def subsets_of(n: int) -> list[list[int]]:
    """The items of each subset of ``n``, by the number whose bits they are."""
    return [[i for i in range(n) if code >> i & 1] for code in range(1 << n)]


def small_pools_at_once(credit: np.ndarray, gross: np.ndarray, net: np.ndarray, withholding_bps: int, tolerance: int, keep: int, refuse: bool) -> tuple[np.ndarray, np.ndarray, list[list[list[int]]]]:
    """(expected, found, kept) as ``Halves`` has them, of pools with one number of payments: a row of ``gross`` and ``net`` each.

    Every subset of every pool is a cell of one array, so a search costs no calls of its own.
    """
    n, half = net.shape[1], net.shape[1] // 2
    bps = lambda x: np.sign(x) * ((np.abs(x) * withholding_bps + 5000) // 10000)
    bits = lambda k: (np.arange(1 << k)[:, None] >> np.arange(k) & 1).T
    (gl, nl), (gr, nr) = ((gross[:, s] @ bits(k), net[:, s] @ bits(k)) for s, k in ((slice(0, half), half), (slice(half, n), n - half)))
    sums = nl[:, :, None] + nr[:, None, :]
    total = net.sum(1)
    width = np.maximum(1, total // STRETCHES)
    lo, hi = credit - width // 2, credit + width // 2
    near = ((sums >= lo[:, None, None]) & (sums <= hi[:, None, None])).sum((1, 2))
    expected = np.where(total > 0, near * (2 * tolerance + 1) / (hi - lo + 1), math.inf)
    fits = np.abs(credit[:, None, None] - (sums - bps(gl[:, :, None] + gr[:, None, :]))) <= tolerance
    fits[:, 0, 0] = False
    if refuse:
        fits &= (expected < C.REFUSE_MIN)[:, None, None]
    pool, left, right = np.nonzero(fits)
    order = np.lexsort((right, (nr - bps(gr))[pool, right], left, pool))
    pool, code = pool[order], (left | right << half)[order]
    first = np.arange(len(pool)) - np.searchsorted(pool, pool) < keep
    kept, subsets = [[] for _ in credit], subsets_of(n)
    for k, c in zip(pool[first].tolist(), code[first].tolist(), strict=True):
        kept[k].append(subsets[c])
    return expected, fits.sum((1, 2)), kept


def searched(pools: DataFrame, withholding_bps: int, tolerance: int = C.NET_TOLERANCE, keep: int = KEEP, refuse: bool = True) -> DataFrame:
    """(bank_row_id, outcome, pool_size, n_solutions, solutions, expected) of pools small enough to be searched.

    pools: bank_row_id, credit_paise, payment_id, amount_paise, fee_paise, tax_paise. Without ``refuse``, credits are searched
    however many subsets fit by chance.
    """

    @F.pandas_udf("found long, kept array<array<int>>, expected double")
    def solve(credits: pd.Series, gross: pd.Series, net: pd.Series) -> pd.DataFrame:
        n, credit = gross.map(len).to_numpy(np.int64), credits.to_numpy(np.int64)
        expected, found, kept = np.zeros(len(n)), np.zeros(len(n), np.int64), [[]] * len(n)
        for size in np.unique(n).tolist():
            of = np.flatnonzero(n == size)
            step = max(1, CELLS >> size)
            for at in np.split(of, range(step, len(of), step)) if size <= AT_ONCE else []:
                expected[at], found[at], some = small_pools_at_once(credit[at], np.stack(gross.iloc[at]), np.stack(net.iloc[at]), withholding_bps, tolerance, keep, refuse)
                for k, x in zip(at.tolist(), some, strict=True):
                    kept[k] = x
            for k in of.tolist() if size > AT_ONCE else []:
                halves = Halves(np.asarray(gross.iloc[k], np.int64), np.asarray(net.iloc[k], np.int64))
                expected[k] = halves.chance(int(credit[k]), tolerance)
                if not refuse or expected[k] < C.REFUSE_MIN:
                    found[k], kept[k] = halves.solutions(int(credit[k]), withholding_bps, tolerance, keep)
        return pd.DataFrame({"found": found, "kept": kept, "expected": expected})

    net = F.col("amount_paise") - F.col("fee_paise") - F.col("tax_paise")
    item = F.struct("payment_id", F.col("amount_paise").cast("long").alias("gross"), net.cast("long").alias("net"))
    rows = pools.groupBy("bank_row_id").agg(F.first("credit_paise").cast("long").alias("credit"), F.array_sort(F.collect_list(item)).alias("m"))
    rows = rows.withColumn("s", solve("credit", "m.gross", "m.net"))
    found = F.col("s.found")
    outcome = F.when(F.lit(refuse) & (F.col("s.expected") >= C.REFUSE_MIN), "UNKNOWN_POOL_TOO_LARGE").when(found == 0, "NO_SUBSET_FOUND").when(found == 1, "MEMBERSHIP_SOLVED").otherwise("AMBIGUOUS_MULTI_CANDIDATE")
    solutions = F.transform("s.kept", lambda s: F.transform(s, lambda i: F.get("m.payment_id", i)))
    return rows.select("bank_row_id", outcome.alias("outcome"), F.size("m").cast("long").alias("pool_size"), found.alias("n_solutions"), solutions.alias("solutions"), F.col("s.expected").alias("expected"))


def log2_chance(size: Column, total: Column, squares: Column, target: Column, tolerance: int) -> Column:
    """Binary logarithm of the subsets that fit by chance in a pool too large to count, from a normal curve over its subset sums."""
    sd = F.sqrt(F.greatest(squares, F.lit(1.0))) / 2
    z = (target - total / 2) / sd
    return size + F.log2(F.lit((2 * tolerance + 1) / math.sqrt(2 * math.pi)) / sd) - z * z / 2 * math.log2(math.e)


def infer_membership(pools: DataFrame, withholding_bps: int, tolerance: int = C.NET_TOLERANCE, cap: int = CAP, keep: int = KEEP, refuse: bool = True) -> DataFrame:
    """(bank_row_id, outcome, pool_size, n_solutions, solutions, expected, confidence) for listed pools (as ``searched`` takes them).

    Sizes are counted first; a pool whose halves have more than ``cap`` subsets isn't shipped, but refused by its sums.
    """
    net = (F.col("amount_paise") - F.col("fee_paise") - F.col("tax_paise")).cast("double")
    sizes = cut(pools.groupBy("bank_row_id").agg(F.first("credit_paise").alias("credit_paise"), F.count("*").alias("pool_size"), F.sum(net).alias("total"), F.sum(net * net).alias("squares")))
    few = sizes.where(F.col("pool_size") <= largest_pool(cap)).select("bank_row_id")
    return _answered(sizes, searched(pools.join(few, "bank_row_id", "left_semi"), withholding_bps, tolerance, keep, refuse), tolerance, cap, refuse)


def _answered(sizes: DataFrame, found: DataFrame, tolerance: int, cap: int, refuse: bool) -> DataFrame:
    large = sizes.where(F.col("pool_size") > largest_pool(cap)).withColumn("log2", log2_chance(F.col("pool_size"), F.col("total"), F.col("squares"), F.col("credit_paise"), tolerance))
    outcome = F.when(F.lit(refuse) & (F.col("log2") >= math.log2(C.REFUSE_MIN)), "UNKNOWN_POOL_TOO_LARGE").otherwise("UNKNOWN_ITERATION_CAP_EXCEEDED")
    none = F.array().cast(found.schema["solutions"].dataType)
    large = large.select("bank_row_id", outcome.alias("outcome"), "pool_size", F.lit(0).cast("long").alias("n_solutions"), none.alias("solutions"), F.when(F.col("log2") < 1000, F.pow(F.lit(2.0), F.col("log2"))).otherwise(float("inf")).alias("expected"))
    solved = F.when(F.col("outcome") == "MEMBERSHIP_SOLVED", C.CONFIDENCE["membership"]).otherwise(0.0)
    return found.unionByName(large).withColumn("confidence", solved)


def memberships(credits: DataFrame, payments: DataFrame, calendar: DataFrame, rates: C.Rates, likeness: Column | None = None, tolerance: int = C.NET_TOLERANCE, cap: int = CAP, keep: int = KEEP) -> DataFrame:
    """(bank_row_id, credit_paise, outcome, pool_size, n_solutions, solutions, expected, band, confidence) of credits no payout explains.

    ``likeness``: a column of ``credits``, how much the narration looks like a payout's; below ``SHAPE_THRESHOLD`` the credit is
    someone's transfer, and no combination of payments is looked for.
    """
    shaped = credits.where(likeness >= C.SHAPE_THRESHOLD) if likeness is not None else credits
    asked = cut(shaped.select("bank_row_id", "event_date", "credit_paise"))
    if asked.isEmpty():
        told = asked.select("bank_row_id", *[F.lit(None).cast(t).alias(c) for c, t in (("outcome", "string"), ("pool_size", "long"), ("n_solutions", "long"), ("solutions", "array<array<string>>"), ("expected", "double"), ("confidence", "double"))])
        return _told(asked, told, credits, likeness)
    due = cut(due_payments(payments, calendar, rates.lag_days, rates.cutoff_hour, rates.withholding_bps))
    days = cut(due_days(asked, due, calendar, C.NET_WINDOW, tolerance))
    sizes = cut(pool_sizes(days, due).join(asked.select("bank_row_id", "credit_paise"), "bank_row_id"))
    pools = small_pools(days, sizes, due, largest_pool(cap)).join(asked.select("bank_row_id", "credit_paise"), "bank_row_id")
    return _told(asked, _answered(sizes, searched(pools, rates.withholding_bps, tolerance, keep), tolerance, cap, True), credits, likeness)


def _told(asked: DataFrame, told: DataFrame, credits: DataFrame, likeness: Column | None) -> DataFrame:
    """Every credit with its answer: one without a pool has no subset, and one that isn't a payout's is skipped."""
    from ledgerloom.operators.attribution import band

    rows = asked.select("bank_row_id", "credit_paise").join(told, "bank_row_id", "left")
    rows = rows.fillna({"outcome": "NO_SUBSET_FOUND", "pool_size": 0, "n_solutions": 0, "confidence": 0.0})
    if likeness is not None:
        skipped = credits.where(~F.coalesce(likeness >= C.SHAPE_THRESHOLD, F.lit(False))).select("bank_row_id", "credit_paise", F.lit("SKIPPED_NOT_PAYOUT_SHAPED").alias("outcome"))
        rows = rows.unionByName(skipped, allowMissingColumns=True)
    return rows.withColumn("band", band(F.col("expected"))).select("bank_row_id", "credit_paise", "outcome", "pool_size", "n_solutions", "solutions", "expected", "band", "confidence")


def probes(payments: DataFrame, sizes: tuple[int, ...], members: int = 4) -> DataFrame:
    """(probe, pool_size, settlement_id, inside, payment_id, amount_paise, fee_paise, tax_paise): pools with a known answer.

    Of each payout with at least ``members`` payments, the ``members`` with the smallest hashes are hidden in a pool of each size
    among payments of other payouts: a stretch of all payments in hash order that begins where the probe's own hash says.
    """
    own = payments.where("settlement_id is not null")
    pick = W.partitionBy("settlement_id").orderBy(F.xxhash64("payment_id"), "payment_id")
    true = own.withColumn("nth", F.row_number().over(pick)).where(F.col("nth") <= members)
    whole = true.groupBy("settlement_id").agg(F.count("*").alias("n")).where(F.col("n") == members).select("settlement_id")
    true = cut(true.join(whole, "settlement_id", "left_semi").select("settlement_id", "payment_id", "amount_paise", "fee_paise", "tax_paise"))
    line, count = numbered(payments.select("payment_id", F.col("settlement_id").alias("of"), "amount_paise", "fee_paise", "tax_paise"), [F.xxhash64("payment_id", F.lit(1)), F.col("payment_id")], "at")
    asked = whole.withColumn("pool_size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("probe", F.concat_ws("/", "settlement_id", "pool_size"))
    need = F.col("pool_size") - members
    # twice as many numbers as needed, as some are of the payout itself; the first that aren't are taken
    start = F.pmod(F.xxhash64("probe"), F.lit(max(count, 1)))
    steps = asked.where(need > 0).withColumn("step", F.explode(F.sequence(F.lit(0), F.least(2 * need + 32, F.lit(max(count, 1))) - 1)))
    drawn = steps.withColumn("at", F.pmod(start + F.col("step"), F.lit(max(count, 1))) + 1).join(line, "at").where(~F.col("of").eqNullSafe(F.col("settlement_id")))
    near = W.partitionBy("probe").orderBy("step")
    decoys = drawn.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= need)
    columns = ["probe", "pool_size", "settlement_id", "inside", "payment_id", "amount_paise", "fee_paise", "tax_paise"]
    return asked.join(true, "settlement_id").withColumn("inside", F.lit(True)).select(*columns).unionByName(decoys.withColumn("inside", F.lit(False)).select(*columns))


def reliability(payments: DataFrame, withholding_bps: int, sizes: tuple[int, ...] = (5, 10, 20, 40, 80), tolerance: int = C.NET_TOLERANCE, cap: int = CAP, members: int = 4) -> DataFrame:
    """(pool_size, tried, computable, cap_hits, truth_found, solved, ambiguous, right, wrong, subsets, reliability) for each size of pool.

    Of the answers that a search would give, as only one subset fits, the share that is right.
    """
    pools = cut(probes(payments, sizes, members))
    gross = F.sum(F.when(F.col("inside"), F.col("amount_paise")))
    fees = F.sum(F.when(F.col("inside"), F.col("fee_paise") + F.col("tax_paise")))
    withheld = F.floor((gross * withholding_bps + 5000) / 10000)
    truth = cut(pools.groupBy("probe").agg((gross - fees - withheld).cast("long").alias("credit_paise"), F.max("pool_size").alias("size"), F.array_sort(F.collect_list(F.when(F.col("inside"), F.col("payment_id")))).alias("true")))
    rows = pools.join(truth.select("probe", "credit_paise"), "probe").select(F.col("probe").alias("bank_row_id"), "credit_paise", "payment_id", "amount_paise", "fee_paise", "tax_paise")
    told = infer_membership(rows, withholding_bps, tolerance, cap, keep=64, refuse=False).withColumnRenamed("bank_row_id", "probe")
    r = truth.join(told, "probe").withColumns({"hit": F.exists("solutions", lambda s: F.array_sort(s) == F.col("true")), "done": F.col("outcome") != "UNKNOWN_ITERATION_CAP_EXCEEDED"})
    one = F.col("n_solutions") == 1
    out = r.groupBy(F.col("size").cast("long").alias("pool_size")).agg(
        F.count("*").alias("tried"), F.count_if("done").alias("computable"), F.count_if(~F.col("done")).alias("cap_hits"), F.count_if("hit").alias("truth_found"), F.count_if(one).alias("solved"),
        F.count_if(F.col("n_solutions") > 1).alias("ambiguous"), F.count_if(one & F.col("hit")).alias("right"), F.count_if(one & ~F.col("hit")).alias("wrong"), F.sum("n_solutions").alias("subsets"),
    )
    return out.withColumn("reliability", F.col("right") / F.nullif(F.col("solved"), F.lit(0)))


def ceiling(curve: DataFrame, least: int = 5) -> DataFrame:
    """(ceiling): the largest pool size up to which each size with answers had ``least`` of them and all were right; 0 without one."""
    bad = F.col("solved").between(1, least - 1) | (F.col("reliability") < 1)
    first = curve.where(bad).agg(F.min("pool_size").alias("first"))  # one row
    good = curve.where((F.col("solved") >= least) & (F.col("reliability") == 1)).join(F.broadcast(first), F.col("first").isNull() | (F.col("pool_size") < F.col("first")))
    return good.agg(F.coalesce(F.max("pool_size"), F.lit(0)).alias("ceiling"))
