"""Business days as a small date dimension: a row for each day, joined instead of computed row by row."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def business_calendar(spark: SparkSession, first: date, last: date, holidays: list[date] | tuple[date, ...] = ()) -> DataFrame:
    """(day, is_business, seq): seq counts the business days up to and including the day. One row for each day."""
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}', interval 1 day)) AS day")
    off = [h.isoformat() for h in holidays]
    open_ = (F.weekday("day") < 5) & ~F.col("day").cast("string").isin(off) if off else F.weekday("day") < 5
    days = days.withColumn("is_business", open_)
    # the dimension is as long as the calendar, whatever the data: a window over all of it is one small task
    return days.withColumn("seq", F.sum(F.col("is_business").cast("long")).over(W.orderBy("day")))


def add_business_days(df: DataFrame, calendar: DataFrame, day: str, n: int | Column, out: str) -> DataFrame:
    """``out``: ``day`` rolled forward to a business day, then n business days later."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = calendar.select(F.col("day").alias("__d"), F.when(F.col("is_business"), F.col("seq")).otherwise(F.col("seq") + 1).alias("__seq"))
    targets = calendar.where("is_business").select(F.col("seq").alias("__to"), F.col("day").alias(out))
    rows = df.join(F.broadcast(starts), df[day] == F.col("__d"), "left").withColumn("__to", F.col("__seq") + n)
    return rows.join(F.broadcast(targets), "__to", "left").drop("__to", "__d", "__seq")


def business_days_between(df: DataFrame, calendar: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``out``: signed count of business days after the earlier day up to the later one."""
    left = calendar.select(F.col("day").alias("__a"), F.col("seq").alias("__sa"))
    right = calendar.select(F.col("day").alias("__b"), F.col("seq").alias("__sb"))
    rows = df.join(F.broadcast(left), df[a] == F.col("__a"), "left").join(F.broadcast(right), df[b] == F.col("__b"), "left")
    return rows.withColumn(out, F.col("__sb") - F.col("__sa")).drop("__a", "__b", "__sa", "__sb")


def capture_day(ts: Column, cutoff_hour: int) -> Column:
    """The batch day of a capture: the next day from the cutoff hour on."""
    return F.when(F.hour(ts) >= cutoff_hour, F.date_add(F.to_date(ts), 1)).otherwise(F.to_date(ts))
