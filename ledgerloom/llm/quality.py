"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of its characters and words (upper case, symbols, digits,
words said twice in a row, ...), and the same shares of the lines before and after it; neighbouring labels have
transition weights. Forward-backward gives each line's marginal, and the length-weighted mean of the marginals over
a document, put on a probability scale by a logistic curve, is its score.

Labels are of documents, not lines: all lines of a good document are good, and a bad one has at least one bad line.
Training starts with every line of a bad document bad, and relabels those that the field finds good.

Null and empty texts have one empty line. Texts are scored whole, however long; one of more than SAMPLE_LINES lines
isn't learned from. Repeated rows each keep their row; of rows with one id the smallest text is learned from. Documents
with contradicting labels, null labels or null ids aren't; if nothing can be learned, every score is 0.5. Other columns
are carried along, but one named as the score's column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import table
from ledgerloom.llm.language import letters, remainder

#: Documents of each label in the sample, the most lines that one of them may have, and the most that those of a label have in all.
SAMPLE, SAMPLE_LINES, LINES = 1500, 2000, 100_000
SYMBOLS, MARKS = "|*%$#&@~^=<>_\\/{}[]+", ".,;:?\"'()-"
OWN = 16
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """For each code point: 0 other, 1 letter, 2 capital, 3 digit, 4 blank, 5 symbol, 6 mark, 7 exclamation."""
    if not _classes:
        c = letters().astype(np.uint8)
        for i in np.flatnonzero(c):
            if chr(i).isupper():
                c[i] = 2
        for k, chars in ((3, "0123456789"), (4, " \t\r\n\x0b\x0c\xa0"), (5, SYMBOLS), (6, MARKS), (7, "!")):
            c[[ord(x) for x in chars]] = k
        _classes.append(c)
    return _classes[0]


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, features) of the text's lines; lengths are at least 1."""
    c = np.frombuffer(((text or "") + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(c == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    kind = classes()[c]
    count = np.stack([np.add.reduceat(kind == k, starts, dtype=np.int64) for k in range(8)], 1).astype(np.float64)
    count[:, 4] -= 1  # the line feed
    chars = np.maximum(size, 1)
    blank = kind == 4
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    words = np.zeros(len(starts))
    repeats, odd_ends, caps, long_ = (np.zeros(len(starts)) for _ in range(4))
    distinct = np.ones(len(starts))
    if len(first):
        last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]]))
        line = np.searchsorted(ends, first)
        n = len(starts)
        words = np.bincount(line, minlength=n).astype(np.float64)
        within = np.arange(len(c)) - np.repeat(first, np.diff(np.concatenate([first, [len(c)]]))) if first[0] == 0 else None
        if within is None:
            within = np.arange(len(c))
            within[first[0] :] -= np.repeat(first, np.diff(np.concatenate([first, [len(c)]])))
        power = np.power(np.uint64(0x9E3779B97F4A7C15), np.arange(64, dtype=np.uint64))
        h = np.add.reduceat(np.where(blank, 0, c).astype(np.uint64) * power[within & 63], first)
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (line[1:] == line[:-1])])
        share = lambda x: np.bincount(line, x, minlength=n) / np.maximum(words, 1)
        repeats, odd_ends, caps = share(same), share((kind[last] == 5) | (kind[last] == 7)), share((kind[first] == 2) & (kind[last] != 1))
        long_ = share(last - first > 24)
        order = np.lexsort((h, line))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])])
        distinct = np.where(words > 0, np.bincount(line[order], new, minlength=n) / np.maximum(words, 1), 1.0)
    letters_ = count[:, 1] + count[:, 2]
    x = np.stack([
        count[:, 2] / np.maximum(letters_, 1), count[:, 5] / chars * 4, count[:, 7] / chars * 4, count[:, 3] / chars * 2,
        count[:, 6] / chars * 4, count[:, 0] / chars * 4, letters_ / chars, repeats, odd_ends, caps, long_, distinct,
        (letters_ / np.maximum(words, 1)) / 20, np.log1p(size) / 6, size == 0, words < 3,
    ], 1).astype(np.float64)
    return chars, np.clip(x, 0, 4)


def spread(x: np.ndarray) -> np.ndarray:
    """Each line's own features, those of its neighbours, and a constant."""
    edge = np.zeros((1, x.shape[1]))
    before, after = np.vstack([edge, x[:-1]]), np.vstack([x[1:], edge])
    ends = np.zeros((len(x), 2))
    ends[0, 0] = ends[-1, 1] = 1
    return np.hstack([x, before[:, :12], after[:, :12], ends, np.ones((len(x), 1))])


@dataclass
class Model:
    weights: np.ndarray  # of "good" against "bad"
    moves: np.ndarray  # 2 by 2 log-weights of neighbouring labels
    curve: np.ndarray  # constant and slopes of the document's logistic curve


def marginals(scores: list[np.ndarray], moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line of each document (in one array, in order), and the expected label pairs summed up.

    All documents are stepped through together, longest first, one line of each at a time.
    """
    n = np.array([len(s) for s in scores])
    order = np.argsort(-n, kind="stable")
    alive = np.cumsum(np.bincount(n, minlength=n.max() + 1)[::-1])[::-1]  # documents with at least t lines
    start = np.concatenate([[0], np.cumsum(n)])[:-1][order]
    flat = np.clip(np.concatenate(scores), -30, 30)
    node = np.stack([np.exp(-flat / 2), np.exp(flat / 2)], 1)
    move = np.exp(moves)
    ahead, behind = np.empty_like(node), np.empty_like(node)
    for t in range(n.max()):
        at = start[: alive[t + 1]] + t
        a = node[at] if t == 0 else node[at] * (ahead[at - 1] @ move)
        ahead[at] = a / a.sum(1, keepdims=True)
    for t in range(n.max() - 1, -1, -1):
        at = start[: alive[t + 1]] + t
        behind[at] = 1.0
        more = at[: alive[t + 2]] if t + 2 < len(alive) else at[:0]
        b = (node[more + 1] * behind[more + 1]) @ move.T
        behind[more] = b / b.sum(1, keepdims=True)
    good = ahead * behind
    good /= good.sum(1, keepdims=True)
    follows = np.ones(len(node), bool)
    follows[start + n[order] - 1] = False
    i = np.flatnonzero(follows)
    pair = ahead[i][:, :, None] * move * (node[i + 1] * behind[i + 1])[:, None, :]
    pairs = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    return good[:, 1], pairs


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 40, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * w.sum() * beta
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * w.sum() * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def summary(lengths: np.ndarray, good: np.ndarray) -> np.ndarray:
    """What the document's curve sees: a constant and the length-weighted mean marginal, plain and as log-odds."""
    q = float(np.clip((lengths * good).sum() / lengths.sum(), 1e-4, 1 - 1e-4))
    return np.array([1.0, 4 * q - 2, np.log(q / (1 - q)) / 4])


def train(docs: list[tuple[int, np.ndarray, np.ndarray]], share_good: float, rounds: int = 4, steps: int = 60) -> Model | None:
    """``docs``: (label, lengths, own features). share_good: the label's share among all labelled documents."""
    if len({d[0] for d in docs}) < 2:
        return None
    xs = [spread(d[2]) for d in docs]
    x, sizes = np.concatenate(xs), np.array([len(d[1]) for d in docs])
    at = np.concatenate([[0], np.cumsum(sizes)])
    label = np.repeat([float(d[0]) for d in docs], sizes)
    n_good = max(1, sum(d[0] for d in docs))
    weight = np.repeat([1 / (n_good if d[0] else len(docs) - n_good) / len(d[1]) for d in docs], sizes) * len(docs)
    y, model = label.copy(), None
    follows = np.ones(len(x), bool)
    follows[at[1:] - 1] = False
    i = np.flatnonzero(follows)
    for _ in range(rounds):
        # the node weights start at their pseudo-likelihood fit; the transitions and a scale are then fitted to the chain
        w = logistic(x, y, weight)
        moves, seen = np.zeros((2, 2)), np.zeros((2, 2))
        np.add.at(seen, (y[i].astype(int), y[i + 1].astype(int)), 1.0)
        gw, gm = np.zeros_like(w), np.zeros_like(moves)
        for _ in range(steps // rounds):
            split = np.split(x @ w, at[1:-1])
            good, pairs = marginals(split, moves)
            dw = x.T @ (y - good) / len(y) - 1e-4 * w
            dm = (seen - pairs) / len(y) - 1e-3 * moves
            gw, gm = gw + dw**2, gm + dm**2
            w, moves = w + 0.15 * dw / np.sqrt(gw + 1e-12), moves + 0.15 * dm / np.sqrt(gm + 1e-12)
        model = Model(w, moves, np.zeros(3))
        good, _ = marginals(np.split(x @ w, at[1:-1]), moves)
        y = label.copy()
        for k, d in enumerate(docs):
            if not d[0]:
                own = good[at[k] : at[k + 1]]
                y[at[k] : at[k + 1]] = own > max(0.5, own.min())
    z = np.stack([summary(d[1], good[at[k] : at[k + 1]]) for k, d in enumerate(docs)])
    target = np.array([float(d[0]) for d in docs])
    prior = np.where(target == 1, share_good / n_good, (1 - share_good) / (len(docs) - n_good)) * len(docs)
    model.curve = logistic(z, target, prior)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model from ``labels`` (id, 0 or 1) and the documents they name.

    The sample is the documents first by a hash of their ids, at most ``sample`` of each label and LINES lines; only
    line features, not texts, come to the driver, some 130 MB at most.
    """
    known = labels.select(F.col(id_col).alias("__ll_id"), F.col(label_col).alias("__ll_y")).where("__ll_id is not null and __ll_y in (0, 1)")
    one = known.groupBy("__ll_id").agg(F.min("__ll_y").alias("__ll_y"), F.max("__ll_y").alias("__ll_y2")).where("__ll_y = __ll_y2").drop("__ll_y2")
    counts = {r["__ll_y"]: r["count"] for r in one.groupBy("__ll_y").count().collect()}
    if len(counts) < 2:
        return None
    pick = lambda y: one.where(F.col("__ll_y") == y).orderBy(F.xxhash64("__ll_id"), "__ll_id").limit(sample)
    chosen = pick(0).unionByName(pick(1))

    def features(batches):
        for pdf in batches:
            out = []
            for y, text in zip(pdf["y"], pdf["text"], strict=True):
                lengths, x = line_features(text)
                out.append((y, lengths.astype(np.float32).tobytes(), x.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["y", "lengths", "x"])

    texts = docs.join(F.broadcast(chosen), docs[id_col] == chosen["__ll_id"]).groupBy(F.col("__ll_id").alias("id"), F.col("__ll_y").cast("int").alias("y")).agg(F.min(F.col(text_col)).alias("text"))
    text = F.coalesce("text", F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    so_far = F.sum("lines").over(W.partitionBy("y").orderBy(F.xxhash64("id"), "id"))  # at most ``sample`` rows each
    texts = texts.withColumn("lines", lines).where(F.col("lines") <= SAMPLE_LINES).withColumn("so_far", so_far).where(F.col("so_far") <= LINES)
    rows = texts.select("y", "text").mapInPandas(features, "y int, lengths binary, x binary").collect()  # at most 2 * LINES lines
    got = sorted((r["y"], bytes(r["lengths"]), bytes(r["x"])) for r in rows)
    parsed = [(y, np.frombuffer(n, np.float32).astype(np.float64), np.frombuffer(x, np.float32).reshape(-1, OWN).astype(np.float64)) for y, n, x in got]
    return train(parsed, counts[1] / sum(counts.values())) if parsed else None


def with_quality(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability that a document is good."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(texts), 0.5))
        result = np.empty(len(texts))
        texts = texts.tolist()
        for at in range(0, len(texts), 256):
            own = [line_features(t) for t in texts[at : at + 256]]
            good, _ = marginals([spread(x) @ model.weights for _, x in own], model.moves)
            parts = np.split(good, np.cumsum([len(n) for n, _ in own])[:-1])
            z = np.stack([summary(n, g) for (n, _), g in zip(own, parts, strict=True)])
            result[at : at + 256] = 1 / (1 + np.exp(-np.clip(z @ model.curve, -30, 30)))
        return pd.Series(result)

    return docs.withColumn(out, score(F.col(text_col)))


def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs, labels.where(remainder("doc_id", 4) != 2))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(True)).alias("held_out")
    scored = with_quality(docs, model)
    return scored.select("doc_id", held_out, "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
