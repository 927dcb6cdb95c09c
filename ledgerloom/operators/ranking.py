"""Numbers over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.checkpoints import cut


def numbered(df: DataFrame, order: list[Column], out: str) -> tuple[DataFrame, int]:
    """``df`` with ``out``, the 1-based number of each row in ``order``, and how many rows there are.

    Rows are dealt by range and numbered within each part; the parts' sizes, a row for each, give the offsets.
    """
    rows = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftrightunsigned("__at", 33))
    before, seen = [], 0
    for part, n in sorted(rows.groupBy("__part").count().collect()):  # a row for each partition of the sort
        before.append((part, seen))
        seen += n
    bases = df.sparkSession.createDataFrame(before, "__part long, __base long")
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__base") + 1
    return rows.join(F.broadcast(bases), "__part").withColumn(out, place).drop("__at", "__part", "__base"), seen
