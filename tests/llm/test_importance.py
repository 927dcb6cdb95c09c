from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from ledgerloom.llm import importance
from ledgerloom.llm.importance import resample, ring_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, n, buckets):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), Counter(crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1))


def brute(docs, target, n, buckets, least, percent, seed):
    s, t = Counter(), Counter()
    for _, text in docs:
        s += runs(text, n, buckets)[1]
    for text in target:
        t += runs(text, n, buckets)[1]
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, own = runs(text, n, buckets)
        weight = sum(gain[b] * c for b, c in own.items()) // own.total() if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, words, own.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    can = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(can[: percent * len(can) // 100]):
        r[5] = k + 1
    return rows


def table(rng, n):
    vocabulary = ["Ab", "b", "c3", "straße", "ÄB", "世界", "x-y", "d_e"] + [f"v{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    docs += [(None, docs[3][1]), (5, docs[5][1]), (5, "another text " * 15), (n + 1, None), (n + 2, ""), (n + 3, "... --- !!!"), (n + 4, "long " * 70000)]
    return docs, [" ".join(rng.choice(vocabulary[:20]) for _ in range(30)) for _ in range(12)] + [None, ""]


@pytest.mark.parametrize(("n", "least", "percent"), [(1, 20, 10), (2, 20, 25), (3, 0, 100)])
def test_draws_against_counts_of_joined_runs(spark, n, least, percent):
    docs, target = table(random.Random(n), 80)
    left = spark.createDataFrame([(i, t, "x", 1.5) for i, t in docs], "doc_id long, text string, bucket string, weight double").repartition(5)
    right = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, id long")
    got = resample(left, right, n=n, buckets=97, least_words=least, percent=percent, seed=7).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, brute(docs, target, n, 97, least, percent, 7)), key=key)


def test_the_ring_holds_states_of_the_last_starts_only(monkeypatch):
    monkeypatch.setattr(importance, "FLUSH", 5)
    text = "one Two three two one two three four"
    for n in (1, 2, 3, 9):
        words, total, counts = ring_scan(text.encode(), n, 10000)
        want = runs(text, n, 10000)[1]
        assert (words, total) == (8, want.total()) and {b: int(counts[b]) for b in np.flatnonzero(counts)} == dict(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    none = docs.where("false")
    assert resample(none, docs).collect() == [] and resample(none, none).collect() == []
    assert [(r["n_features"], r["rank"]) for r in resample(docs, none, percent=100).collect()] == [(40, 1)]
