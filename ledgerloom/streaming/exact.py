"""The exact tier over streams: settlements wait for their credit until the posting window and the allowed delay are over."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.calendar import add_business_days

#: Calendar days within which every posting window of C.EXACT_WINDOW business days ends; it bounds what is kept as state.
LONGEST = 21


def exact_stream(settlements: DataFrame, credits: DataFrame, calendar: DataFrame, delay: str = "6 days") -> DataFrame:
    """(settlement_id, bank_row_id, due): each credit that has a settlement's reference, amount and window, as it arrives.

    A settlement without any comes once with a null bank_row_id, after the watermark has passed its window. Both
    inputs may be streams. References, amounts and dates that are null match nothing; rows later than ``delay``
    behind the newest of their stream may be left out, as in any watermarked join. Whether a pair is the only one of
    its settlement and of its credit is for the reader of the output to ask (``operators.matching.mutual_unique``).
    """
    s = add_business_days(settlements, calendar, "event_date", C.EXACT_WINDOW, "hi")
    s = s.select("settlement_id", F.col("utr").alias("s_utr"), "net_paise", F.col("event_date").cast("timestamp").alias("due"), F.col("hi").cast("timestamp").alias("until")).withWatermark("due", delay)
    c = credits.where("utr is not null").select("bank_row_id", F.col("utr").alias("c_utr"), "credit_paise", F.col("event_date").cast("timestamp").alias("posted")).withWatermark("posted", delay)
    on = F.expr(f"s_utr = c_utr and net_paise = credit_paise and posted >= due and posted <= until and posted <= due + interval {LONGEST} days")
    return s.join(c, on, "leftOuter").select("settlement_id", "bank_row_id", "due")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """What the stream gives for all that its sources hold now; a run that is cut off goes on from its checkpoint."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def as_stream(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as files, and read as a stream of them."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)
