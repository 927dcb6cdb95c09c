from __future__ import annotations

import math
import random

import corpus_pipeline
from ledgerloom.llm import jaccard


def brute_set(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_kept(rows, least=0.8):
    """The smallest id of each component, all sets compared with all."""
    sets = [(i, brute_set(t)) for i, t in rows]
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a == b or (a and b and len(a & b) >= least * len(a | b)):
                p, q = find(x), find(y)
                top[max(p, q)] = min(p, q)
    first = {}
    for x, (i, _) in enumerate(sets):
        first[find(x)] = min(i, first.get(find(x), i))
    return sorted(first.values())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_stage_equals_all_pairs(spark):
    rng = random.Random(5)
    shared = [f"w{rng.randrange(3000)}" for _ in range(60)]
    texts = ["", None, "one", "One", "one two three", "a b c d e", "A b c d  e", "a b c d e f"]
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 12, 40, 120]))] + (shared if rng.random() < 0.3 else [])
        for _ in range(rng.choice([1, 1, 3, 6])):  # chains of near ones, around 0.8
            texts.append(" ".join(words))
            words = edited(rng, words, rng.randrange(1, 2 + len(words) // 40))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want


def test_a_group_of_near_copies_and_rows_without_ids(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(80)]
    docs = spark.createDataFrame([*rows, (None, rows[3][1]), (None, "quite another text"), rows[0]], "doc_id long, text string")
    assert sorted((r["doc_id"] for r in jaccard.keep_one(docs).collect()), key=str) == [0, None]


def test_sketches_drop_a_similar_pair_with_a_chance_of_a_billionth_at_most():
    for n in (0, 1, 5, 20, jaccard.SKETCH):
        bound = jaccard.least_hits(n, 0.8)
        below = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(bound))
        assert 0 <= bound <= n and below <= 1e-9
    assert jaccard.least_hits(jaccard.SKETCH, 0.8) > 12  # a third as similar is dropped, as a rule


def test_no_rows(spark):
    assert jaccard.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
