"""The pipeline's near_dedup keeps what op10 links together, whatever its sets have in common."""

from __future__ import annotations

import random

import corpus_pipeline
from ledgerloom.llm import jaccard
from tests.llm.test_jaccard import brute_kept, brute_set, edited
from tests.llm.test_simhash import brute_fingerprint


def brute_kept_by_both(rows, least=0.8, limit=3):
    """The smallest id of each component of either kind of link, all texts compared with all."""
    known = [(i, brute_set(t), brute_fingerprint(t)) for i, t in rows]
    group = {i: {i} for i, _, _ in known}
    for x, (i, a, p) in enumerate(known):
        for j, b, q in known[:x]:
            alike = a == b or (a and b and len(a & b) >= least * len(a | b)) or (p ^ q).bit_count() <= limit
            if alike and group[i] is not group[j]:
                both = group[i] | group[j]
                group.update((k, both) for k in both)
    return sorted({min(g) for g in group.values()})


def edited_texts():
    """Families of texts with edits all over: most members have less than 0.8 of their five-word shingles in common."""
    rng = random.Random(11)
    texts = ["", None, "one"]
    for f in range(12):
        base = [f"f{f}w{rng.randrange(400)}" for _ in range(300)]
        texts += [" ".join(edited(rng, base, 8)) for _ in range(8)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_links_of_the_simhash_index_count(spark, monkeypatch):
    rows = edited_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda: sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    want = brute_kept_by_both(rows)
    assert len(want) < len(brute_kept(rows))
    assert kept() == want
    monkeypatch.setattr(jaccard, "links", lambda distinct, limit: distinct.selectExpr("fp a", "fp b").limit(0))
    assert len(kept()) > len(want)


def test_equal_sets_with_different_fingerprints_link_by_each(spark):
    """A sentence repeated leaves the set of shingles as it is and moves the fingerprint."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    period = words[:60]
    once, often = [*period, *period, *words], [*period * 40, *words]
    rows = [(0, " ".join(often)), (1, " ".join(once)), (2, " ".join([*edited(rng, period * 40, 20), *words]))]
    assert brute_set(rows[0][1]) == brute_set(rows[1][1])
    assert brute_fingerprint(rows[0][1]) != brute_fingerprint(rows[1][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute_kept_by_both(rows)
