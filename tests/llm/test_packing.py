from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing

TEXTS = [None, "", "a", "word " * 5000, "Straße ÉCOLE İstanbul", "<|endoftext|> x <|startoftext|>", "日本語 text 😀", "it's we'll I'D 12a3", "\x00 \x01", " ſpecial ŉ ǆ Ǆ", "tab\tnew\nline\r\n", "a" * 9000, "ʼn ﬁ é", "x y z"]


def test_encoder_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.Encoder(packing.default_tokenizer(), words=50)
    rng = random.Random(2)
    alphabet = "abcDEFéÜİıſßœ 0123'-_.,!\n\t ­ŉǅɏ'sllve" + "".join(map(chr, range(0x80, 0x250)))
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for t in [x or "" for x in TEXTS] + made:
        assert encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def test_texts_together_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.Encoder(packing.default_tokenizer(), words=30)
    rng = random.Random(5)
    tails = ["", ".", ",***", "'s", "'.", "'ll,", "_", "!!", "12", "x", "²", "«", " ", "\t\n", "  "]
    made = [" " * (i % 3) + " ".join("".join(rng.choice("abcéÜª'") for _ in range(rng.randint(0, 4))) + rng.choice(tails) for _ in range(rng.randint(0, 30))) for i in range(300)]
    texts = [x or "" for x in TEXTS] + made
    rng.shuffle(texts)
    got = [ids for some in packing.together(texts, 500) for ids in encode.all(some)]
    assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert [t for some in packing.together(texts, 500) for t in some] == texts and list(packing.together([], 500)) == []


def counted(encode, monkeypatch) -> list[list[str]]:
    """The lists of words that ``encode`` gives to the tokenizer from here on."""
    calls, learn = [], encode.learn
    monkeypatch.setattr(encode, "learn", lambda words: (calls.append(list(words)), learn(words)))
    return calls


def test_new_words_of_many_texts_are_encoded_in_one_go(monkeypatch):
    encode = packing.Encoder(packing.default_tokenizer())
    calls = counted(encode, monkeypatch)
    made = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(1000, 1200)]
    encode.all([f"{w}, common {w}. {w}***" for w in made])
    assert [sorted(words) for words in calls] == [sorted([*made, "common", ",", ".", "***"])]
    encode.all([f"{w}. {w}" for w in made])
    assert len(calls) == 1


def test_words_met_of_late_outlast_a_full_memory(monkeypatch):
    encode = packing.Encoder(packing.default_tokenizer(), words=8)
    calls = counted(encode, monkeypatch)
    for i in range(97, 97 + 26):
        encode("every " + chr(i))
        encode("every " + chr(max(97, i - 1)))
        assert len(encode.known) + len(getattr(encode, "older", {})) <= 12
    words = [word for call in calls for word in call]
    assert len(words) == len(set(words)) == 27


@pytest.mark.parametrize("size", [1, 7, 64])
def test_plan_places_each_length_as_often_as_it_is(size):
    rng = random.Random(size)
    histogram = {n: rng.randint(1, 50) for n in range(1, size + 1) if rng.random() < 0.7} or {1: 3}
    patterns = packing.plan_packs(histogram, size)
    placed = defaultdict(int)
    for count, parts in patterns:
        assert sum(n * times for n, times in parts) <= size
        for n, times in parts:
            placed[n] += count * times
    assert dict(placed) == histogram
    assert packing.plan_packs({}, size) == []


def test_every_id_lies_in_one_piece_of_a_gapless_sequence(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "one two " * rng.randint(0, 60)) for i in range(150)] + [(7, TEXTS[7]), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, length string")
    size = 256
    got = packing.pack_documents(docs, size=size).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = defaultdict(list)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), size):
            part = ids[start : start + size]
            want[i].append((start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(ids)))
    have, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        have[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    tokens = sum(r["length"] for r in got)
    assert len(sequences) <= -(-tokens // size) + 2  # little padding


def test_no_rows(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_length_is_ranked_by_as_many_tasks_as_it_needs(spark):
    assert packing.salts({}, 8) == packing.salts({8: 64}, 8, each=1) == 64
    per = spark.createDataFrame([(n,) for n in range(1, 9)], "length long").select(packing.salts({8: 1000, 3: 70, 2: 5}, 8, each=2).alias("s"))
    assert [r["s"] for r in per.collect()] == [64] * 7 + [500]


def test_many_tasks_for_the_full_length(spark, monkeypatch):
    monkeypatch.setattr(packing.salts, "__defaults__", (1,))
    pieces = spark.createDataFrame([(i, 0, 8, 0, 8) for i in range(300)] + [(1000 + i, 0, 3, 0, 3) for i in range(90)], packing.PIECES)
    got = packing.pack(pieces, 8).collect()
    assert sorted(r["sequence_id"] for r in got if r["length"] == 8) == sorted(set(r["sequence_id"] for r in got if r["length"] == 8)) and len(got) == 390
    short = [(r["sequence_id"], r["offset"]) for r in got if r["length"] == 3]
    assert len(set(short)) == 90 and {o for _, o in short} <= {0, 3}
