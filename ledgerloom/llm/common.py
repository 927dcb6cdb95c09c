"""What the training-data operators share: reading tables, cutting lineage, batches for Python, ranking without a hot task."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bytes of an Arrow batch where rows are whole texts, and the setting that holds it.
BATCH, BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where that is unset and Spark local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df`` as reliable checkpoint files: a lost executor re-reads them instead of repeating the work above."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like ``cut``, but later plans know its size and read single columns."""
    path = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started within send texts to Python in batches of about BATCH bytes, or one row, instead of 10 000 rows.

    Spark holds a batch of texts several times over, in the executor and in its Python worker.
    """
    was = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(BATCH))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, was)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_rank(df: DataFrame, key: str, order: list[Column], out: str, salt: Column, salts: int | Column = 64) -> DataFrame:
    """``out``: 0-based rank of each row within ``key`` by (salt, ``order``).

    A key with a third of all rows is ranked in ``salts`` tasks (a number, or a column that depends on the key alone): rows are numbered within (key, salt), and the
    counts of the smaller salts, one row for each (key, salt), give the offsets.
    """
    s, n, base = "__ll_salt", "__ll_n", "__ll_base"
    parts = df.withColumn(s, F.pmod(salt, F.lit(salts) if isinstance(salts, int) else salts).cast("int"))
    counts = parts.groupBy(key, s).agg(F.count("*").alias(n))
    before = W.partitionBy(key).orderBy(s).rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(key, s, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    inner = F.row_number().over(W.partitionBy(key, s).orderBy(*order)) - 1
    ranked = parts.withColumn(out, inner.cast("long"))
    right = bases.select(F.col(key).alias("__ll_k"), F.col(s).alias("__ll_s"), base)
    on = F.col(key).eqNullSafe(F.col("__ll_k")) & (F.col(s) == F.col("__ll_s"))
    return ranked.join(right, on, "left").withColumn(out, F.col(out) + F.col(base)).drop("__ll_k", "__ll_s", base, s)


def numbered(df: DataFrame, order: list[Column], out: str) -> tuple[DataFrame, int]:
    """``df`` with ``out``, the 1-based number of each row in ``order``, and how many rows there are.

    The sort deals rows by range, and each part is numbered by itself; the parts' sizes, one row for each, give the
    offsets. Rows that are equal in ``order`` can come in any sequence.
    """
    at, part, base = "__ll_at", "__ll_part", "__ll_base"
    rows = cut(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftrightunsigned(at, 33))
    sizes = sorted(rows.groupBy(part).count().collect())  # a row for each partition of the sort
    before, seen = [], 0
    for k, n in sizes:
        before.append((k, seen))
        seen += n
    bases = df.sparkSession.createDataFrame(before, f"{part} long, {base} long")
    local = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(bases), part).withColumn(out, local + F.col(base) + 1).drop(at, part, base), seen
