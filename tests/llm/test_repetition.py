from __future__ import annotations

import random
import re

import pytest

from ledgerloom.llm import repetition
from ledgerloom.llm.repetition import judged, measured, with_repetition

WORD = re.compile("[^ \t-\r]+")


def positions(words, k):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    return {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + k)}


def brute(text, window=5, shortest=3):
    """Every substring of words is looked at: its places, and what stands before and behind them."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    longest, maximal = 0, 0
    for k in range(1, len(words)):
        places = {}
        for i in range(len(words) - k + 1):
            places.setdefault(tuple(words[i : i + k]), []).append(i)
        for at in places.values():
            if len(at) > 1:
                longest = k
                around = lambda side: {words[i + side] if 0 <= i + side < len(words) else ("edge", i) for i in at}  # noqa: B023, E731
                maximal += k >= shortest and len(around(-1)) > 1 and len(around(k)) > 1
    inside = positions(words, shortest)
    spans = [{"start": a, "end": next(e for e in range(a, len(words) + 1) if e not in inside)} for a in sorted(inside) if a - 1 not in inside]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(positions(words, window)), "covered_words": len(inside), "longest_repeat": longest, "n_maximal": maximal, "spans": spans,
    }


def merged(spans):
    """Spans that touch are one where positions are compared."""
    out = []
    for s in spans:
        if out and out[-1]["end"] == s["start"]:
            out[-1]["end"] = s["end"]
        else:
            out.append(dict(s))
    return out


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t ", "one", "a " * 40, "a b " * 31, "a b c d e f " * 9, "x\x1cy\x85z\xa0w q", "grüß 世界 <b> & | #\n" * 4, "l1 x\nl1 x\r\nl1 x\n\n\nl1 x"]
    for alphabet in (2, 3, 8, 30):
        out += [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF"[:alphabet]) for _ in range(rng.randrange(5, 70))) for _ in range(12)]
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    return [*out, " ".join(base), " ".join(base + base[20:75]), " ".join(base * 3)]


@pytest.mark.parametrize("at_once", [7, 1 << 18])
def test_measures_against_every_substring(monkeypatch, at_once):
    monkeypatch.setattr(repetition, "AT_ONCE", at_once)
    given = texts()
    got = measured([None if t is None else t.encode() for t in given]).to_dict("records")
    for text, row in zip(given, got, strict=True):
        row["spans"] = merged(row["spans"])
        assert row == brute(text), text


def test_a_long_periodic_text_ends():
    words = [b"p%d" % (i % 7) for i in range(60000)]
    row = measured([b" ".join(words)]).iloc[0]
    assert (row["n_repeat_words"], row["longest_repeat"], len(row["spans"])) == (60000, 60000 - 7, 1)


def test_verdicts_over_a_table_with_odd_rows(spark):
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    clean, passage = fresh(400), fresh(60)
    rows = [
        (1, clean, "s", True, "r"), (1, clean, "s", True, "r"), (None, clean, None, None, None), (2, None, None, None, None), (3, "", "", False, ""),
        (4, "too short", "", None, ""), (5, "again and again and so on " * 12, "", None, ""), (6, " ".join([fresh(600), passage, fresh(5), passage]), "", None, ""),
        (7, "", "", None, ""), (8, " ".join(f"{fresh(1)} in the end" for _ in range(40)), "", None, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean, spans string")
    got = judged(docs).collect()
    assert [r["doc_id"] for r in got if r["repetition"]["kept"]] == [1, 1, None]
    assert [r["doc_id"] for r in got if r["repetition"]["base_failed"]] == [2, 3, 4, 5, 7]
    assert next(r for r in got if r["doc_id"] == 6)["repetition"]["longest_repeat"] == 60
    assert {(r["n_words"], r["kept"], r["spans"]) for r in got} == {(r[2], r[3], r[4]) for r in rows}
    with pytest.raises(ValueError, match="repetition"):
        with_repetition(docs.withColumnRenamed("spans", "repetition"))
    assert judged(docs.where("false")).collect() == []
