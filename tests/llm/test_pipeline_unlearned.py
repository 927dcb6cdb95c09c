"""Stages that can learn nothing keep their documents."""

from __future__ import annotations

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = "The rain fell on the old tin roof and nobody said a word about it at all."


def test_documents_without_any_language_stay(spark):
    docs = spark.createDataFrame([(i, TEXT, None, "web", len(TEXT)) for i in range(5)], SCHEMA)
    assert corpus_pipeline.language_id(spark, docs, "").count() == 5


@pytest.mark.parametrize("labels", [[], [(i, 1) for i in range(5)], [(100 + i, i % 2) for i in range(40)]])
def test_documents_without_useful_labels_stay(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, TEXT, "en", "web", len(TEXT)) for i in range(5)], SCHEMA)
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == 5


def test_empty_tables_give_no_sequence(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
