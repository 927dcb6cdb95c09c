from __future__ import annotations

import numpy as np
import pytest

from ledgerloom.llm import language

EN = "the quick brown fox jumps over the lazy dog and then it runs away from the old farmer who lives near the river "
DE = "der schnelle braune fuchs springt ueber den faulen hund und dann laeuft er weg von dem alten bauern am fluss "
ES = "el rapido zorro marron salta sobre el perro perezoso y luego huye del viejo granjero que vive cerca del rio "


def test_em_finds_the_best_proportion():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(30), 2)
    n = rng.multinomial(4000, 0.3 * p[0] + 0.7 * p[1]).astype(float)
    theta, ll = language.em(p, n)
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([n @ np.log(g * p[0] + (1 - g) * p[1]) for g in grid])]
    assert abs(theta[0] - best) < 0.01 and ll >= max(n @ np.log(g * p[0] + (1 - g) * p[1]) for g in grid) - 0.05


def model(spark):
    rows = [(i, t * 3, k) for i, (t, k) in enumerate([(EN, "en"), (DE, "de"), (ES, "es")] * 4)]
    rows += [(50, None, "en"), (51, EN, None), (None, DE, "de"), (52, "", "es")]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_single_mixed_and_undetermined_texts(spark):
    m = model(spark)
    assert m[0] == ["de", "en", "es"]
    rows = [(1, EN), (2, DE), (3, ES), (4, EN * 2 + DE * 2), (5, None), (6, ""), (7, "123 !! \n"), (8, EN * 4000), (8, EN * 4000), (None, ES), (9, "q")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["mixture"]) for r in language.with_language(docs, m, prefix="p_").select("doc_id", "p_lang_pred", "p_score", "p_mixture").toDF("doc_id", "lang_pred", "score", "mixture").collect()]
    by = {g[0]: g for g in got}
    assert len(got) == len(rows) and [by[i][1] for i in (1, 2, 3, 8, None)] == ["en", "de", "es", "en", "es"]
    assert all(by[i][1:3] == ("und", 0.0) for i in (5, 6, 7))
    assert set(by[4][3]) == {"en", "de"} and abs(by[4][3]["en"] - 0.5) < 0.1
    assert all(0 <= g[2] <= 1 for g in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, EN, None)], "doc_id long, text string, lang string")
    m = language.fit(docs)
    assert language.with_language(docs, m).first()["lang_pred"] == "und"
    assert language.with_language(docs.where("false"), m).count() == 0


@pytest.mark.parametrize("text", ["a", "ab", "A-b", "é" * 10, "x" * 10])
def test_trigrams_do_not_depend_on_the_step(text, monkeypatch):
    whole = language.trigrams(text * 3)
    monkeypatch.setattr(language, "STEP", 1 << 30)
    again = language.trigrams(text * 3)
    assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").where("lang is not null").collect()}
    rows = [(lang[r["doc_id"]], r["lang_pred"]) for r in language.op6_language_id(spark, sf).collect() if r["held_out"] and r["doc_id"] in lang]
    assert sum(a == b for a, b in rows) / len(rows) > 0.9
