"""Repetition inside a text, from suffix arrays over its words.

The words of many texts lie in one array, each tagged with its text, so that no repeat goes from one text into the
next; the array of all suffixes is sorted by prefix doubling, which after each round looks only at suffixes that are
still tied. Intervals of the longest-common-prefix array whose prefix can't be extended to either side are the maximal
repeated substrings. A text fails if the union of their spans covers too much of it or the longest is too long.

The spans are united without listing every occurrence: a suffix's innermost interval has the larger of its two
neighbouring prefixes, and a repeat that could be extended to the left lies inside a longer one, so the union over
innermost intervals is the union over maximal repeats. Occurrences may overlap.

A text is read whole by one task, which takes some 100 bytes a word for it at most. Null and empty texts have no words and
fail the base rule. Rows with equal or null ids are each measured by themselves; other columns stay as they are,
and one named like an output is refused. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

#: Words of a base window, words of the shortest repeat that counts, words that are sorted at once (a longer text alone).
WINDOW, SHORTEST, AT_ONCE = 5, 3, 1 << 18
#: Fixed values of the base rule: least words, greatest percentage of words in repeated windows.
LEAST_WORDS, BASE_PERCENT = 10, 20
#: A text is kept if at most this percentage of its words lies in maximal repeats, and none has more words than that.
COVERED_PERCENT, LONGEST = 30, 50

_BYTES = np.arange(256)
_BLANK = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_POINT = (_BYTES & 0xC0) != 0x80
_SYMBOL = np.isin(_BYTES, np.frombuffer(b"#*$%&|<>", np.uint8))

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, n_maximal long, spans array<struct<start:bigint,end:bigint>>"


def suffixes(sym: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, longest common prefix with the suffix before) of ``sym``; suffixes end at their text's end.

    ``ends``: for each position, the end of its text. Symbols of different texts must differ.
    """
    n = len(sym)
    sa = np.argsort(sym, kind="stable")
    fresh = np.r_[True, sym[sa][1:] != sym[sa][:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    rounds, k = [rank.astype(np.int32)], 1
    while True:
        alone = fresh & np.r_[fresh[1:], True]
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        a = sa[at]
        after = a + k
        inside = after < ends[a]
        key = rank[a] * (n + 1) + np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        a, key = a[order], key[order]
        sa[at] = a
        new = np.r_[True, key[1:] != key[:-1]]
        fresh[at] = new
        rank[a] = at[new][np.cumsum(new) - 1]
        rounds.append(rank.astype(np.int32))
        k *= 2
    lcp = np.zeros(n, np.int64)
    x, y = sa[:-1].copy(), sa[1:].copy()
    for level in range(len(rounds) - 1, -1, -1):
        step = 1 << level
        live = np.flatnonzero((x < ends[sa[:-1]]) & (y < ends[sa[1:]]))
        same = live[rounds[level][x[live]] == rounds[level][y[live]]]
        # equal ranks may come from suffixes that both end within the step; then they would be one suffix, so none do
        lcp[1:][same] += step
        x[same] += step
        y[same] += step
    return sa, lcp


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(length, first rank, last rank) of the intervals that extend to neither side, of ``shortest`` words or more.

    ``before``: for each position the symbol before it, or one of its own where a text begins.
    """
    left = before[sa]
    changes = np.cumsum(np.r_[0, left[1:] != left[:-1]])
    out, stack, last = [], [], -2

    def close(upto: int, height: int) -> int:
        low = upto
        while stack and stack[-1][0] > height:
            length, low = stack.pop()
            if changes[upto - 1] > changes[low]:
                out.append((length, low, upto - 1))
        return low

    for i in np.flatnonzero(lcp >= shortest).tolist():
        if i != last + 1:
            close(last + 1, 0)
        h = int(lcp[i])
        low = close(i, h) if stack and stack[-1][0] > h else i - 1
        if not stack or stack[-1][0] < h:
            stack.append((h, low))
        last = i
    close(last + 1, 0)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """The union of [start, start + length) of rising starts, as disjoint spans."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(starts + lengths)
    fresh = np.r_[True, starts[1:] > reach[:-1]]
    return list(zip(starts[fresh].tolist(), reach[np.r_[fresh[1:], True]].tolist(), strict=True))


def repeats(texts: list[list[bytes]], window: int, shortest: int) -> list[tuple]:
    """(words in repeated windows, words in maximal repeats, longest, number of maximal repeats, spans) of each list of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    if not n:
        return [(0, 0, 0, 0, [])] * len(texts)
    words = pd.factorize(np.array([w for t in texts for w in t], dtype=object))[0].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    sym = doc * (int(words.max()) + 1) + words
    sa, lcp = suffixes(sym, (begin + sizes)[doc])
    longest = np.zeros(n, np.int64)
    longest[sa] = np.maximum(lcp, np.r_[lcp[1:], 0])
    before = np.r_[-1, sym[:-1]]
    before[begin[sizes > 0]] = -1 - np.arange((sizes > 0).sum())
    firsts = np.array([low for _, low, _ in maximal_repeats(sa, lcp, before, shortest)], np.int64)
    found = np.bincount(doc[sa[firsts]], minlength=len(texts))
    out = []
    for d, (b, size) in enumerate(zip(begin.tolist(), sizes.tolist(), strict=True)):
        own = longest[b : b + size]
        at = np.flatnonzero(own >= shortest)
        if not len(at) and window >= shortest:
            out.append((0, 0, int(own.max(initial=0)), 0, []))
            continue
        spans = covered(at, own[at])
        wide = np.flatnonzero(own >= window)
        total = lambda s: sum(e - a for a, e in s)
        out.append((total(covered(wide, own[wide])), total(spans), int(own.max(initial=0)), int(found[d]), [{"start": a, "end": e} for a, e in spans]))
    return out


def measured(data: list[bytes | None], window: int = WINDOW, shortest: int = SHORTEST) -> pd.DataFrame:
    """``MEASURES`` of each text, given as UTF-8."""
    rows, held, size = [], [], 0
    plain = []

    def flush() -> None:
        rows.extend((*p, *r) for p, r in zip(plain, repeats(held, window, shortest), strict=True))
        plain.clear()
        held.clear()

    for text in data:
        text = text or b""
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
        plain.append((len(words), int(counts[_POINT].sum() - counts[_BLANK].sum()), int(counts[_SYMBOL].sum()), len(lines) - len(set(lines))))
        if size + len(words) > AT_ONCE and held:
            plain_last = plain.pop()
            flush()
            plain.append(plain_last)
            size = 0
        held.append(words)
        size += len(words)
    flush()
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")])


def with_repetition(docs: DataFrame, text_col: str = "text", out: str = "repetition", window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` and a struct ``out`` of MEASURES; spans are in words, from 0, without their ends."""
    if out in docs.columns:
        raise ValueError(f"the documents have a column {out} already")

    @F.pandas_udf(MEASURES)
    def measure(text: pd.Series) -> pd.DataFrame:
        return measured(text.tolist(), window, shortest)

    return docs.withColumn(out, measure(F.col(text_col).cast("binary")))


def judged(docs: DataFrame, text_col: str = "text", out: str = "repetition", least_words: int = LEAST_WORDS, base_percent: int = BASE_PERCENT, covered_percent: int = COVERED_PERCENT, longest: int = LONGEST) -> DataFrame:
    """``docs`` with ``out`` and, in it, base_failed and kept: the base rule, and the limits on maximal repeats."""
    r = lambda c: F.col(f"{out}.{c}")
    failed = (r("n_words") < least_words) | (100 * r("n_repeat_words") > base_percent * r("n_words"))
    good = (100 * r("covered_words") <= covered_percent * r("n_words")) & (r("longest_repeat") <= longest)
    return with_repetition(docs, text_col, out).withColumn(out, F.col(out).withField("base_failed", failed).withField("kept", ~failed & good))


def op11_suffix_repetition(spark, sf_dir):
    docs = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")
    return docs.select("doc_id", *[F.col(f"repetition.{c}").alias(c) for c in names])


#: A repeat of more than LONGEST words is a window of LONGEST + 1 words that is found twice.
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (3), (5), (51)) AS ks(k) WHERE len(w) >= k)
), twice AS (
  SELECT r, k, i FROM (SELECT r, k, i, count(*) OVER (PARTITION BY r, k, s) AS n FROM win) WHERE n > 1
), hit AS (
  SELECT r, k, count(DISTINCT p) AS words FROM (SELECT r, k, unnest(range(i, i + k)) AS p FROM twice) GROUP BY r, k
), ln AS (
  SELECT r, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ln.dup, 0)::BIGINT AS n_dup_lines,
    coalesce(h5.words, 0)::BIGINT AS n_repeat_words, coalesce(h3.words, 0)::BIGINT AS covered_words, h51.words IS NOT NULL AS too_long
  FROM d LEFT JOIN ln USING (r) LEFT JOIN hit h5 ON h5.r = d.r AND h5.k = 5 LEFT JOIN hit h3 ON h3.r = d.r AND h3.k = 3 LEFT JOIN hit h51 ON h51.r = d.r AND h51.k = 51
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * covered_words <= 30 * n_words AND NOT too_long AS kept, covered_words
FROM m
"""
