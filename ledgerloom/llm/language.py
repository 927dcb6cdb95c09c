"""Language identification as multilingual mixture inference.

Each language has a distribution over hashed letter trigrams, counted over a bounded sample of labelled documents.
A document is a mixture of languages: expectation-maximisation estimates the proportions from its trigrams'
likelihoods, for language sets grown one language at a time as long as the likelihood gains more than a penalty for
the further language. The prediction is the language with the largest proportion; the score is that proportion
times the posterior of the language among single languages.

The likelihood is concave in the proportions, so its gradient at the best single language bounds what any set can
gain; most documents stop there without an iteration.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing can be learned.
Null languages and null ids are never learned from. Repeated rows each keep their row. A very long text is read in
steps of STEP code points, so its counts take no more memory than those of a short one. Columns of the documents that are
named lang_pred, score or mixture (with the prefix) are replaced; no other column is read or changed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

#: Trigram buckets, documents of each language in the sample (on average over the hash), code points looked at in one go.
BUCKETS, SAMPLE, STEP = 1 << 14, 2000, 1 << 21
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's letter trigrams, and their counts; words are set apart by one blank."""
    total = np.zeros(BUCKETS, np.int64)
    text = text or ""
    for at in range(0, len(text), STEP):
        part = text[max(0, at - 2) : at + STEP].lower()
        c = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        c = np.where(letters()[c], c, 0)
        c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])]
        if len(c) < 3:
            continue
        h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total += np.bincount((h >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of each bucket) from labelled ``docs``.

    About ``sample`` documents of each language take part, chosen by a hash of their ids.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    have = rows.groupBy("lang").count().collect()  # a row for each language
    if not have:
        return [], np.zeros((0, BUCKETS))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in have], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text")

    def count(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                total = np.zeros(BUCKETS, np.int64)
                for t in texts:
                    at, n = trigrams(t)
                    total[at] += n
                at = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    counts = chosen.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # at most BUCKETS rows for each language
    langs = sorted(got["lang"].unique())
    table_ = np.full((len(langs), BUCKETS), 0.5)
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        table_[k, own["bucket"].to_numpy(np.int64)] += own["n"].to_numpy(np.float64)
    return langs, np.log(table_ / table_.sum(1, keepdims=True))


def em(p: np.ndarray, n: np.ndarray, rounds: int = 200, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``p`` (languages by trigrams) that fit the counts ``n``, and the log-likelihood."""
    theta, last = np.full(len(p), 1 / len(p)), -np.inf
    for _ in range(rounds):
        mixed = theta @ p
        ll = float(n @ np.log(mixed))
        theta = theta * (p @ (n / mixed)) / n.sum()
        if ll - last < tolerance * max(1.0, abs(ll)) * 1e-2:
            break
        last = ll
    return theta, ll


def infer(at: np.ndarray, n: np.ndarray, logp: np.ndarray, penalty: float) -> tuple[dict[int, float], float]:
    """(proportion of each chosen language, posterior of the best single one)."""
    lp = logp[:, at]
    single = lp @ n
    best = int(single.argmax())
    posterior = 1.0 / float(np.exp(np.clip(single - single[best], -700, 0)).sum())
    cost = penalty * np.log(n.sum() + 1.0)
    chosen, gained, theta = [best], float(single[best]), np.ones(1)
    ratio = np.exp(np.clip(lp - lp[best], -60, 60))
    if len(logp) == 1 or float((ratio @ n).max()) - float(n.sum()) <= cost:
        return {best: 1.0}, posterior
    p = np.exp(lp - lp.max(0))
    shift = float(n @ lp.max(0))
    while len(chosen) < len(logp):
        tries = []
        for k in range(len(logp)):
            if k not in chosen:
                t, ll = em(p[[*chosen, k]], n)
                tries.append((ll + shift, k, t))
        ll, k, t = max(tries, key=lambda x: (x[0], -x[1]))
        if ll - gained <= cost:
            break
        chosen, gained, theta = [*chosen, k], ll, t
    return dict(zip(chosen, map(float, theta), strict=True)), posterior


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", penalty: float = 6.0, prefix: str = "") -> DataFrame:
    """``docs`` with <prefix>lang_pred, <prefix>score and <prefix>mixture (language to proportion)."""
    langs, logp = model
    logp = logp.astype(np.float32).astype(np.float64)

    @F.pandas_udf("lang_pred string, score double, mixture map<string,double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            at, n = trigrams(t)
            if not len(at) or not langs or not any(map(str.isalpha, t)):
                out.append(("und", 0.0, {}))
                continue
            theta, posterior = infer(at, n.astype(np.float64), logp, penalty)
            top = max(theta, key=lambda k: (theta[k], -k))
            out.append((langs[top], min(1.0, theta[top] * (posterior if len(theta) == 1 else 1.0)), {langs[k]: v for k, v in theta.items()}))
        return pd.DataFrame(out, columns=["lang_pred", "score", "mixture"])

    got = docs.withColumn("__ll_lang", predict(F.col(text_col)))
    return got.withColumns({f"{prefix}{c}": F.col(f"__ll_lang.{c}") for c in ("lang_pred", "score", "mixture")}).drop("__ll_lang")


def remainder(id_col: str, by: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(by))


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(remainder("doc_id", 5) != 0))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out")
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")
