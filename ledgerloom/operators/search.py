"""Finding rows by a part of their text, through postings of three letters, and by key, in bucketed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text):
    """The distinct stretches of GRAM characters of a text, whatever its case; none of a shorter one."""
    low = F.lower(text)
    at = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substring(low, i, F.lit(GRAM)))))


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, key): which rows hold which stretch. Write it bucketed by gram, and a search reads the buckets of its own."""
    return rows.select(F.explode(grams(F.col(text))).alias("gram"), key)


def search(rows: DataFrame, posted: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(wanted, key) of the rows whose text holds each of ``wanted`` (wanted: a text), whatever the case.

    Rows that have all stretches of a wanted text are looked at, no others; one too short to have a stretch is looked for in
    all rows. ``wanted`` is a list of questions, each of bounded length, and is sent to the postings. A null text holds nothing.
    """
    asked = wanted.select("wanted").distinct().withColumn("grams", grams(F.col("wanted")))
    few = asked.where("grams is not null").select("wanted", F.size("grams").alias("need"), F.explode("grams").alias("gram"))
    near = posted.join(F.broadcast(few), "gram").groupBy("wanted", key).agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need").select("wanted", key)
    holds = F.contains(F.lower(F.col(text)), F.lower("wanted"))
    told = rows.select(key, text)
    found = near.join(told, key).where(holds).select("wanted", key)
    short = told.join(F.broadcast(asked.where("grams is null").select("wanted")), holds).select("wanted", key)
    return found.unionByName(short)


def store_by_key(rows: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """``rows`` as a table of the catalogue, in ``buckets`` by ``key`` and sorted within them; a lookup by key reads one bucket, and joins
    on it with a table of as many buckets need no exchange."""
    rows.write.bucketBy(buckets, key).sortBy(key).mode("error").saveAsTable(table)
    return rows.sparkSession.table(table)
