from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, limit=3):
    """fingerprint to the smallest fingerprint it reaches, compared all with all."""
    fps = sorted(set(fps))
    top = {f: f for f in fps}

    def find(f):
        while top[f] != f:
            f = top[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= limit:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "É É É É", "x " * 70_000, "  a", "A\x00B c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) % (1 << 64) == brute_fingerprint(text)


def test_gray_rank_is_the_inverse_of_the_gray_code(spark):
    rng = random.Random(1)
    ranks = sorted(rng.getrandbits(64) for _ in range(50)) + [0, 1, (1 << 64) - 1]
    df = spark.createDataFrame([(signed(r ^ (r >> 1)), str(r)) for r in ranks], "fp long, r string")
    got = {r["r"]: r["g"] for r in df.select("r", simhash.gray_rank(F.col("fp")).alias("g")).collect()}
    assert all(got[str(r)] == signed(r ^ (1 << 63)) for r in ranks)


def fingerprints(seed, n):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 12])):  # chains of near ones
            out.append(f)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
    return out


@pytest.mark.parametrize("group_rows", [16, 10_000])
def test_components_equal_all_pairs(spark, group_rows):
    fps = fingerprints(3, 400)
    want = brute_components(fps)
    df = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long")
    labels = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 3, group_rows)).collect()}
    mine = {}
    for f in want:
        mine.setdefault(labels.get(signed(f), signed(f)), set()).add(f)
    theirs = {}
    for f, root in want.items():
        theirs.setdefault(root, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_forest_prunes_without_losing_a_link():
    fps = np.array(sorted(set(fingerprints(8, 300))), dtype=np.uint64)
    top = simhash.forest(fps, None, 3)
    want = brute_components([int(f) for f in fps])
    for i in range(len(fps)):
        for j in range(i):
            assert (top[i] == top[j]) == (want[int(fps[i])] == want[int(fps[j])])


def test_documents(spark):
    base = "the cat sat on the mat while the rain fell on the old tin roof and nobody said a word about it at all"
    rows = [(5, base), (3, base), (9, base.upper()), (4, base + " end"), (7, None), (8, ""), (6, " "), (None, base), (None, "quite another text here"), (11, "some other words"), (5, base)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, fp string, component_id string")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    fps = {t: brute_fingerprint(t) for _, t in rows}
    roots = brute_components(fps.values())
    first = {}
    for i, t in rows:
        if i is not None:
            r = roots[fps[t]]
            first[r] = min(i, first.get(r, i))
    want = sorted(((i, f"{fps[t]:016x}", first.get(roots[fps[t]])) for i, t in rows), key=repr)
    assert sorted(got, key=repr) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([*first.values(), None], key=repr)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0
