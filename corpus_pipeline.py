"""From documents to packed training sequences, in stages that each apply one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, language, mixing, packing, quality
from ledgerloom.llm.common import checkpoint_root, table

#: A document goes if it has no language or no language has this share of it.
LEAST_LANGUAGE = 0.5
#: A document goes if the probability that it is good is below this.
LEAST_QUALITY = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; the languages are learned from the documents' own labels. Without any, all stay."""
    model = language.fit(docs)
    if not model[0]:
        return docs
    told = language.with_language(docs, model, prefix="__ll_")
    return told.where((F.col("__ll_lang_pred") != "und") & (F.col("__ll_score") >= LEAST_LANGUAGE)).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are good; learned from the labels of documents outside the held-out quarter.

    Where nothing can be learned (no labels, labels of one class, or of no document here), all stay.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(language.remainder("doc_id", 4) != 2)
    model = quality.fit(docs, labels)
    if model is None:
        return docs
    scored = quality.with_quality(docs, model, out="__ll_quality")
    return scored.where(F.col("__ll_quality") >= LEAST_QUALITY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id.

    Documents are linked where op10 links them, their SimHash fingerprints being three bits apart or less, and where
    five-word shingles have a similarity of 0.8 or more, most of which three bits miss.
    """
    return jaccard.keep_one(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mixing_sources", mixing_sources),
    ("packing", pack),
]

#: Trained models, sampling and tokenizers have no SQL form. The tests compare near duplicates with all pairs, and the
#: other stages with their operators, which have brute-force or held-out tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
