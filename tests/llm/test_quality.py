from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from ledgerloom.llm import quality
from ledgerloom.llm.language import remainder

GOOD = "The river was calm in the morning, and the boats came in one after another."
BAD = "$$$ BUY NOW!!! click click click || %%% ### 0000 >>> !!!"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    moves = rng.normal(size=(2, 2))
    scores = [rng.normal(size=n) * 2 for n in (1, 4, 6)]
    good, pairs = quality.marginals(scores, moves)
    want, seen = [], np.zeros((2, 2))
    for s in scores:
        ways = list(itertools.product((0, 1), repeat=len(s)))
        w = np.array([np.exp(sum((y - 0.5) * x for y, x in zip(way, s)) + sum(moves[a, b] for a, b in zip(way, way[1:]))) for way in ways])
        w /= w.sum()
        want += [w[[k for k, way in enumerate(ways) if way[t]]].sum() for t in range(len(s))]
        for p, way in zip(w, ways):
            for a, b in zip(way, way[1:]):
                seen[a, b] += p
    assert np.allclose(good, want)
    assert np.allclose(pairs, seen)


@pytest.mark.parametrize("text", [None, "", "\n", "a", "\n\nx\n", " lead", "x" * 5000, "é😀 ！", "A b\tC\r\nd e f"])
def test_line_features_have_a_row_for_each_line(text):
    lengths, x = quality.line_features(text)
    assert len(lengths) == len(x) == (text or "").count("\n") + 1
    assert x.shape[1] == quality.OWN and np.isfinite(x).all() and (lengths >= 1).all()


def made(n, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 2
        lines = [GOOD[: rng.randint(20, len(GOOD))] if good or rng.random() < 0.3 else BAD[rng.randint(0, 10) :] for _ in range(rng.randint(2, 12))]
        if not good:
            lines.append(BAD)
        docs.append((i, "\n".join(lines), "clash"))
        labels.append((i, good, 0))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = made(120)
    d = spark.createDataFrame([*docs, (1000, None, ""), (1001, "", ""), (1002, "w " * 300_000, ""), docs[0], (None, "text", "")], "doc_id long, text string, score string")
    l = spark.createDataFrame([*labels, (1001, None, 0), (5000, 1, 0), (0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, l.where(remainder("doc_id", 4) != 2))
    got = [(r["doc_id"], r["score"]) for r in quality.with_quality(d, model).collect()]
    assert len(got) == 125 and all(0 <= s <= 1 for _, s in got)
    held = [(i, s) for i, s in got if i is not None and i < 120 and (s >= 0.7) == bool(i % 2)]
    assert len(held) >= 115


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    l = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.fit(d, l) is None
    assert quality.with_quality(d, None).first()["score"] == 0.5
    assert quality.with_quality(d.where("false"), None).count() == 0


def test_accuracy_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["doc_id"], r["predicted"]) for r in quality.op3_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(labels[i] == p for i, p in rows)
    assert right / len(rows) > 0.85, (right, len(rows))
