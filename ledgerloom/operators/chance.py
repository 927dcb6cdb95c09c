"""How many items or pairs there surely are that chance alone makes fit a gap: a floor for every size of gap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a gap's size and bins of an item's, for each doubling.
CELLS, BINS = 16, 32


@dataclass(frozen=True)
class Floors:
    """For each cell of sizes the chance fits there surely are, of one item of each kind and of pairs; ``top`` is the largest amount."""

    top: int
    tolerance: int
    single: dict[str, np.ndarray]
    pair: np.ndarray

    def open_cells(self, which: str, most: float) -> list[int]:
        """Cells in which a strong cause is possible: of a kind, or of "pair"."""
        floor = self.pair if which == "pair" else self.single.get(which, np.zeros(0))
        return np.flatnonzero(floor < most).tolist()

    def table(self, spark) -> DataFrame:
        """(cell, at_least) for pairs, a few hundred rows."""
        return spark.createDataFrame([(k, float(x)) for k, x in enumerate(self.pair)], "cell long, at_least double")


def cell_of(size: Column) -> Column:
    return F.floor(CELLS * F.log2(F.greatest(size, F.lit(1)).cast("double")))


def chance_floors(items: DataFrame, tolerance: int) -> Floors:
    """From counts of items in bins of their amounts, less as many as the largest batch has: a batch's own items are no causes."""
    own = items.where("magnitude > 0").dropDuplicates(["item_id", "magnitude", "item_settlement"])
    bin_ = F.floor(BINS * F.log2(F.col("magnitude").cast("double")))
    counted = own.groupBy("kind", bin_.alias("bin")).agg(F.count("*").alias("n"), F.max("magnitude").alias("top")).collect()  # kinds times some 2000 bins at most
    most = own.where("item_settlement is not null").groupBy("item_settlement").count().agg(F.max("count")).first()[0] or 0
    top = max((r["top"] for r in counted), default=0)
    n_cells = int(CELLS * np.log2(2 * top + 2 * tolerance + 2)) + 2 if top else 0
    k = np.arange(n_cells)
    x, y = 2.0 ** (k / CELLS) * (1 - 1e-9), 2.0 ** ((k + 1) / CELLS) * (1 + 1e-9)
    least, upto = y / 2 + tolerance, 1.5 * x - 2 - tolerance
    each = (2 * tolerance + 1) / (y + 2)

    def edges(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at: dict[int, int] = {}
        for r in rows:
            at[r["bin"]] = at.get(r["bin"], 0) + r["n"]
        b = np.array(sorted(at), np.float64)
        return 2.0 ** (b / BINS) * (1 - 1e-9), 2.0 ** ((b + 1) / BINS) * (1 + 1e-9), np.array([at[int(i)] for i in b], np.float64)

    def surely(lo, hi, n) -> np.ndarray:
        return np.array([n[(lo >= a) & (hi <= b)].sum() for a, b in zip(least, upto, strict=True)])

    single = {}
    for kind in {r["kind"] for r in counted}:
        single[kind] = each * np.maximum(surely(*edges([r for r in counted if r["kind"] == kind])) - most, 0)
    lo, hi, n = edges(counted)
    i, j = np.triu_indices(len(lo))
    ways = np.where(i == j, n[i] * (n[i] - 1) / 2, n[i] * n[j]) if len(lo) else np.zeros(0)
    near = np.array([n[lo <= 1.5 * b + tolerance].sum() for b in y])
    pair = each * np.maximum(surely(lo[i] + lo[j], hi[i] + hi[j], ways) - most * near, 0) if len(lo) else np.zeros(n_cells)
    return Floors(int(top), tolerance, single, pair)
