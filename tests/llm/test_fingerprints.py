from __future__ import annotations

import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from ledgerloom.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, fingerprint string, d string"


def canonical(t: str) -> str:
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"[\s\x1c-\x1f\x85  ]+", " ", t).strip(" ")


def brute(rows):
    rows = sorted(rows, key=lambda r: r[0])
    texts = [r[1] or "" for r in rows]
    out = {}
    for k, (i, _) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), canonical(t), canonical(edited), canonical(after))
    return out


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 7)  # many ranges
    rng = random.Random(1)
    words = ["Straße", "STRASSE", "ﬁn", "FIN", "é", "é", " ", "Ⅷ", "x", "😀", "İ", " ", "\t\n", ""]
    rows = [(rng.randint(0, 10**6) * 7 + k % 7, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for k in range(150)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(-5, None), (10**7 + 1, ""), (10**7 + 2, "a" * 200_000), (10**7 + 3, "  A "), (10**7 + 4, "a")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = {r["doc_id"]: r for r in fp.fingerprint_documents(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    by_form = {}
    for i, (n, sha, own, edited, after) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["near_edited"], r["near_next"]) == (float(own == edited), float(own == after))
        assert by_form.setdefault(own, r["fingerprint"]) == r["fingerprint"]
        assert by_form.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert len(set(by_form.values())) == len(by_form)


def test_equal_digests_are_split_by_their_bytes(spark):
    df = spark.createDataFrame([("d1", "a"), ("d1", "a"), ("d2", "b"), ("d2", "c"), ("d3", "e")], "d string, c string")
    assert [r["d"] for r in fp.split_buckets(df, "d", "c").collect()] == ["d2"]


def test_repeated_and_null_ids_and_one_row(spark):
    rows = [(1, "same text", "", ""), (1, "same text", "", ""), (None, "x", "", ""), (None, None, "", "")]
    got = fp.fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in got) == [(False, 9), (False, 9), (True, 0), (True, 1)]
    one = fp.fingerprint_documents(spark.createDataFrame([(1, "abcd", "", "")], SCHEMA)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abca").hexdigest() and one["near_next"] == 1.0
    assert fp.fingerprint_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_canonical_form(spark):
    texts = ["ΑΣ", "ας", "ǰ", "ẖ", "ﬀ", "ℌ", "a b", "a\x1cb", "ͅ", "ᾳ", "K", "ſ", "a  b", "﻿a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", fp.canonical(F.col("t")).alias("c")).collect():
        assert r["c"] == canonical(r["t"]), r["t"]


def test_a_shared_id_is_dealt_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 5)
    rng = random.Random(4)
    for hot in (None, 7, -(2**63) + 1, 2**63 - 1):
        rows = [(hot, f"shared {k}") for k in range(80)] + [(rng.randint(-50, 50), f"own {k}") for k in range(80)]
        df = spark.createDataFrame(rows, "doc_id long, text string").select(F.coalesce("doc_id", F.lit(fp.FIRST)).alias("key"), F.xxhash64("text").alias("tie"), "text")
        rows = sorted(df.collect(), key=lambda r: (r["key"], r["tie"]))
        led = fp.with_next(df, "key", "tie", ["text"])
        got = {r["text"]: r["next_text"] for r in led.collect()}
        assert got == {r["text"]: rows[(i + 1) % len(rows)]["text"] for i, r in enumerate(rows)}
        assert led.count() == len(rows)
