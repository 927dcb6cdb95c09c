"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are cut into full sequences and one rest. The histogram of piece lengths has one entry for each length up
to the sequence length, so it goes to the driver whatever the number of documents. Lengths are placed longest
first, always into the pack that is shortest so far; packs of the same make-up are one pattern with a count. The
patterns then say, for each length, which run of ranks lands at which offset of which sequences, and pieces are
joined to them by their rank within the length.

Null texts count as empty: such a document is its end token alone. A very long text is encoded whole by one task and
cut into as many pieces as it needs. Repeated rows, and rows with equal or null ids, are packed each; pieces that are equal
in id, start and content may change places, which changes no sequence. Only the id and the text are read, so other
columns may have any names, those of the result included. An empty table gives no piece.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, salted_rank, small_batches, table

#: The tokenizer's split into words, as its file states it, over the code points below (fixed value).
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
#: Texts within these code points are split here and their words looked up; normalisation leaves such texts as they are but for case.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]*")
#: Characters of texts whose new words are encoded in one go.
TOGETHER = 2 << 20
#: Pieces of one length that a task ranks; every length is dealt to 64 tasks at least.
RANKED = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes; words already met are looked up, in bounded memory. Of texts that
    are given together, each run without white space is looked up once, and the new words are encoded in one go."""

    def __init__(self, path: str, words: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), words
        self.known, self.older = {}, {}  # words met of late, and before that
        self.words = Tokenizer(self.tokenizer.model)  # for lower-case words that are split already
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, words: list[str]) -> None:
        """The ids of new words, encoded in one go: each word's last token, and no other, is marked as a word's end."""
        ids = np.array(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        data, start = ids.tobytes(), 0
        for word, end in zip(words, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
            self.known[word] = data[start:end]
            start = end

    def runs(self, runs: list[str]) -> list[bytes]:
        """The ids of runs without white space, in lower case."""
        if len(self.known) > self.most // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, runs))
        missing = [i for i, ids in enumerate(found) if ids is None]
        inside = []
        for run in map(runs.__getitem__, missing):
            if run.isalpha():
                inside.append((run,))
            elif (core := run.rstrip(punctuation)).isalpha():
                inside.append((core, run[len(core) :]))
            else:
                inside.append(SPLIT.findall(run))
        words = set(chain.from_iterable(inside)).difference(known)
        known.update({word: older[word] for word in words if word in older})
        if new := list(words.difference(known)):
            self.learn(new)
        for i, parts in zip(missing, inside, strict=True):
            found[i] = b"".join([known[word] for word in parts])
        return found

    def all(self, texts: list[str]) -> list[bytes]:
        plain = ["<|" not in text and PLAIN.fullmatch(text) is not None for text in texts]  # no special tokens or other normalisation
        # no word holds white space, and such texts have none beyond ASCII
        own = pc.ascii_split_whitespace(pa.array([text.lower() if p else "" for text, p in zip(texts, plain, strict=True)], pa.large_string()))
        coded = own.flatten().dictionary_encode()
        ids = self.runs(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        run = coded.indices.to_numpy()
        counts = sizes[run]
        ends = np.cumsum(counts)
        at = np.repeat((np.cumsum(sizes) - sizes)[run] - (ends - counts), counts)
        at += np.arange(len(at))
        data = np.frombuffer(b"".join(ids), dtype="<u4")[at].tobytes()
        cuts = (4 * np.append(0, ends)[own.offsets.to_numpy()]).tolist()
        return [data[a:b] if p else self.whole(text).tobytes() for text, p, a, b in zip(texts, plain, cuts, cuts[1:], strict=False)]

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0]


def together(texts: list[str], most: int) -> Iterator[list[str]]:
    """``texts`` in lists of ``most`` characters or a text more."""
    some, chars = [], 0
    for text in texts:
        some.append(text)
        if (chars := chars + len(text)) >= most:
            yield some
            some, chars = [], 0
    if some:
        yield some


def cut_documents(docs: DataFrame, size: int, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of at most ``size`` ids: doc_id, start, length, ids_crc32, doc_tokens."""

    def pieces(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = Encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            out = []
            texts = (ids for some in together([text or "" for text in pdf["text"]], TOGETHER) for ids in encode.all(some))
            for doc_id, ids in zip(pdf["doc_id"], texts, strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    out.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            pdf = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield pdf.astype({"doc_id": "Int64"} if len(pdf) else {"doc_id": "Int64", "start": "int64", "length": "int64", "ids_crc32": "int64", "doc_tokens": "int64"})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInPandas(pieces, PIECES)


def plan_packs(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (count, [(length, times), ...]) from the histogram of lengths.

    Each length opens at most two new patterns and splits at most one, so patterns number at most three for each length.
    """
    packs: list = []  # a heap: (filled, order of making, count, make-up as a linked list)
    made = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and packs and packs[0][0] + length <= size:
            filled, _, count, inside = heapq.heappop(packs)
            use = min(count, left)
            if count > use:
                heapq.heappush(packs, (filled, (made := made + 1), count - use, inside))
            # a pack that took this length is the longer for it, and waits its turn among the others
            heapq.heappush(packs, (filled + length, (made := made + 1), use, ((length, 1), inside)))
            left -= use
        per = size // length
        for count, times in ((left // per, per), (1, left % per)):
            if count and times:
                heapq.heappush(packs, (length * times, (made := made + 1), count, ((length, times), None)))
    out = []
    for _, _, count, inside in packs:
        parts: dict[int, int] = {}
        while inside:
            (length, times), inside = inside
            parts[length] = parts.get(length, 0) + times
        out.append((count, sorted(parts.items(), reverse=True)))
    return out


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Runs of ranks of each length, sorted by (length, first rank): where rank r of a length goes."""
    rows, next_rank, base = [], {}, 0
    for count, parts in patterns:
        offset = 0
        for length, times in parts:
            first = next_rank.get(length, 0)
            rows.append((length, first, base, count, offset))
            next_rank[length] = first + count * times
            offset += length * times
        base += count
    rows.sort()
    names = ("length", "first", "base", "count", "offset")
    return dict(zip(names, np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def salts(histogram: dict[int, int], size: int, each: int = RANKED) -> int | Column:
    """Tasks that rank a length: as many as its pieces need, of ``each``; most of a large corpus is in pieces of the full length."""
    if max(histogram.values(), default=0) <= 64 * each:
        return 64
    return F.element_at(F.array(*[F.lit(max(64, -(-histogram.get(n, 0) // each))) for n in range(1, size + 1)]), F.col("length").cast("int"))


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` (length, at most ``size``) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    at = slots(plan_packs(histogram, size))
    keys = (at["length"] << 44) + at["first"]
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32")]
    ranked = salted_rank(pieces, "length", order, "__ll_rank", F.xxhash64("doc_id", "start"), salts(histogram, size))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
        k = rank - at["first"][run]
        return pd.DataFrame({"sequence_id": at["base"][run] + k % at["count"][run], "offset": at["offset"][run] + k // at["count"][run] * length})

    return ranked.withColumn("__ll_at", place("length", "__ll_rank")).select(*pieces.columns, "__ll_at.sequence_id", "__ll_at.offset")


def pack_documents(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: PIECES, sequence_id, offset. The pieces of a sequence lie from offset 0 without gaps."""
    with small_batches(docs.sparkSession):
        pieces = cut(cut_documents(docs, size, tokenizer or default_tokenizer(), end_id, id_col, text_col))
    return pack(pieces, size)


def op5_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
