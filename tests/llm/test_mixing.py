from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, h string, size string, copies string"


def docs_of(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        rows.append((i, " ".join(["w"] * min(int(rng.paretovariate(1.1) * 5), 4000)), source))
    return rows


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == {"a": 200, "b": pytest.approx(250 / 3), "c": pytest.approx(500 / 3)}
    t = mixing.targets([("b", 10), (None, 1000), ("a", 5)])
    assert t["a"] == 10 and sum(t.values()) == pytest.approx(1015 * 1.5) and t["b"] == 20
    assert mixing.targets([]) == {}
    assert mixing.targets([("a", 0)]) == {"a": 0}


@pytest.mark.parametrize("block", [8, 64])
def test_mix_is_near_its_targets_and_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(mixing.decide, "__defaults__", (block,))
    rows = docs_of(600) + [(7000, None, "a"), (7001, "", "a"), (7002, None, None), (7003, "u v", "zero?"), (None, "x y", "b")] + docs_of(3)
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    got = mixing.mix(df).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted({(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows if i is not None})
    assert sum(r["m"] for r in got) == len(rows)
    taken, target, size = defaultdict(int), {}, {}
    for r in got:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"] * r["m"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    for s in target:
        assert target[s] <= 2 * size[s] + 1e-9
        if size[s] > 100:
            assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 20, (s, taken[s], target[s])
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["source"], r["h"], r["copies"])
    assert sorted(map(key, got), key=repr) == sorted(map(key, again), key=repr)


def test_flight_keeps_its_constraints():
    rng = np.random.default_rng(4)
    pi = rng.random(200)
    rows = np.vstack([rng.integers(1, 99, 200), np.ones(200)]).astype(float)
    want = rows @ pi
    mixing.flight(pi, rows, rng)
    assert np.allclose(rows @ pi, want) and ((pi > 0) & (pi < 1)).sum() <= 2


def test_documents_are_repeated(spark):
    df = spark.createDataFrame([(*r, "", "", "") for r in docs_of(200)], SCHEMA)
    out = mixing.repeat_mixed(df)
    assert out.columns == df.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    have = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert have == {i: n for i, n in copies.items() if n}


def test_no_rows_and_no_words(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    r = mixing.mix(spark.createDataFrame([(1, "", "a", "", "", "")], SCHEMA)).collect()
    assert [(x["target"], x["copies"]) for x in r] == [(0.0, 0)]
