"""Whole texts go to Python in batches of a few MB, so that an executor doesn't hold a task's texts several times over."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.llm import common, jaccard, packing


def long_texts(spark):
    """12 MB in one task."""
    return spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))


def test_packing_reads_texts_in_small_batches(spark, monkeypatch):
    def sizes(docs, *_):
        def of(batches):
            for pdf in batches:
                yield pd.DataFrame({"doc_id": [int(pdf["text"].str.len().sum())], "start": [0], "length": [1], "ids_crc32": [0], "doc_tokens": [1]})

        return docs.mapInPandas(of, packing.PIECES)

    before = spark.conf.get(common.BATCH_BYTES, None)
    monkeypatch.setattr(packing, "cut_documents", sizes)
    held = [r["doc_id"] for r in packing.pack_documents(long_texts(spark)).collect()]
    assert sum(held) == 3000 * 4000 and max(held) <= 1.5 * common.BATCH
    assert spark.conf.get(common.BATCH_BYTES, None) == before


def test_near_dedup_reads_texts_in_small_batches(spark, monkeypatch):
    seen, marked = [], jaccard.marked
    monkeypatch.setattr(jaccard, "marked", lambda own, *rest: seen.append(own.sparkSession.conf.get(common.BATCH_BYTES, None)) or marked(own, *rest))
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect()) == [1, 3]
    assert seen == [str(common.BATCH)] and spark.conf.get(common.BATCH_BYTES, None) is None


def test_the_setting_comes_back_after_an_error(spark):
    spark.conf.set(common.BATCH_BYTES, "123456")
    try:
        with common.small_batches(spark):
            raise KeyError
    except KeyError:
        assert spark.conf.get(common.BATCH_BYTES) == "123456"
    finally:
        spark.conf.unset(common.BATCH_BYTES)
