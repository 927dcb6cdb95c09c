"""The pipeline's stages against plain versions over a small table."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from ledgerloom.llm import language, mixing, packing, quality
from tests.llm.test_jaccard import brute_kept


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "web", 0), (None, "12 34", None, "web", 5)], docs.schema)
    docs = docs.unionByName(odd)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "near_dedup", "mixing_sources", "packing"]

    told = corpus_pipeline.language_id(spark, docs, tiny)
    assert told.columns == columns
    model = language.fit(docs)
    want = Counter()
    for r in docs.collect():
        at, n = language.trigrams(r["text"])
        if len(at):
            theta, posterior = language.infer(at, n.astype(float), model[1].astype("f4").astype("f8"), 6.0)
            if max(theta.values()) * (posterior if len(theta) == 1 else 1.0) >= corpus_pipeline.LEAST_LANGUAGE:
                want[tuple(r)] += 1
    assert rows_of(told) == want

    good = corpus_pipeline.quality_classifier(spark, told, tiny)
    assert good.columns == columns and not rows_of(good) - rows_of(told)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    before = [r["doc_id"] for r in told.collect() if labels.get(r["doc_id"]) == 1]
    after = {r["doc_id"] for r in good.collect()}
    assert sum(i in after for i in before) >= 0.9 * len(before)

    one = corpus_pipeline.near_dedup(spark, good, tiny)
    assert one.columns == columns
    # five-word shingles of similarity 0.8 or more, all sets compared with all
    assert sorted(r["doc_id"] for r in one.collect()) == brute_kept([(r["doc_id"], r["text"]) for r in good.select("doc_id", "text").collect()])

    mixed = corpus_pipeline.mixing_sources(spark, one, tiny)
    assert mixed.columns == columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(one).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    packed = corpus_pipeline.pack(spark, mixed, tiny).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed.collect()}
    first = {}
    for r in packed:
        first.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in parts) <= 2048 and min(parts)[0] == 0 for parts in first.values())
    assert sum(r["start"] == 0 for r in packed) == mixed.count()


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert set(out.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"} and out.count() > 0
    assert quality and packing
