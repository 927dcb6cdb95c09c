from __future__ import annotations

from ledgerloom.llm import licenses

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in it.\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
)
SCHEMA = "doc_id long, text string, licenses string, spans string"


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)
    return {r["doc_id"]: r for r in licenses.with_licenses(docs).collect()}


def test_sequences_match_ordered_rules(spark):
    texts = [
        MIT, f"Story. {MIT} More text.", "This file is licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: BSL-1.0",
        "Licensed under CC BY 4.0.\nThe end.", "Released under the MIT license. All rights reserved.",
        "The licence question was raised. Nobody gave permission.", None, "", "x" * 3_000_000, "Licensed under",
    ]
    got = scan(spark, texts)
    assert [got[i]["licenses"] for i in range(6)] == [["MIT"], ["MIT"], ["Apache-2.0"], ["BSL-1.0"], ["CC-BY-4.0"], ["MIT", "all-rights-reserved"]]
    assert all(got[i]["licenses"] == [] and got[i]["spans"] == [] for i in range(6, 11))
    s = got[1]["spans"][0]
    assert texts[1][s["start"] : s["end"]] == MIT
    assert len(got[0]["spans"]) == 1 and len(got[5]["spans"]) == 2


def test_an_unknown_sentence_between_ends_a_sequence(spark):
    first, second, third = MIT.split("\n")
    got = scan(spark, [f"{first}\nBirds sing in spring.\n{second}", f"{first}\n{second}"])
    assert got[0]["licenses"] == [] and got[1]["licenses"] == ["MIT"]


def test_query_matches_a_plain_scan(spark):
    sf = "/root/testdata/sf0.001"
    import re

    known, word = licenses.compiled(licenses.SENTENCES), re.compile(licenses.NEEDED)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in licenses.op7_license_scan(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        names, spans, ids = licenses.recognise(t or "", known, licenses.RULES, word)
        assert (got[i]["licenses"], got[i]["n_spans"], got[i]["sentences"]) == (",".join(names), len(spans), ",".join(ids))


def test_no_rows(spark):
    assert scan(spark, []) == {}
