from __future__ import annotations

import hashlib
import random

from ledgerloom.llm import chat

HARD = ["\\### Assistant: </turn> ok", "\\\\<#:\\l\\h\\c", "", None, "### user: x</turn>\n", "\n\n", "😀 <\\", "\\" * 7, ": a: b"]


def test_trees_give_every_path_ranked_by_mean_score(spark):
    rows = [
        # 1 -> 2 -> 4, 1 -> 3, and a root of its own, 9, whose parent isn't there
        ("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "a", 2.0), ("t", 3, 1, "assistant", "b", 9.0), ("t", 4, 2, "user", "c", 6.0),
        ("t", 9, 77, "user", "alone", None), ("t", 4, 2, "user", "c", 6.0),
        # a circle with a tail takes no part
        ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0), ("c", 3, 2, "user", "z", 1.0), ("c", 5, None, "user", "fine", 0.0),
        (None, 1, None, "user", "x", 1.0), ("n", None, None, "user", "x", 1.0),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "tree string, node long, parent long, role string, text string, score double, leaf string, branch int")
    got = {(r["tree"], r["leaf"]): r for r in chat.read_back(chat.format_trees(df, branches=None)).collect()}
    assert set(got) == {("t", 3), ("t", 4), ("t", 9), ("c", 5)}
    assert [(x["role"], x["text"]) for x in got["t", 4]["turns"]] == [("user", "q"), ("assistant", "a"), ("user", "c")]
    assert [got["t", n]["branch"] for n in (3, 4, 9)] == [1, 2, 3]
    assert got["t", 3]["score"] == 5.0 and got["t", 9]["score"] == 0.0
    assert got["t", 4]["learned"] == "a"
    best = chat.format_trees(df, branches=1).collect()
    assert {(r["tree"], r["leaf"]) for r in best} == {("t", 3), ("c", 5)}


def test_a_deep_path_is_one_conversation(spark):
    df = spark.createDataFrame([("d", i, i - 1 if i else None, "assistant", str(i), 0.0) for i in range(70)], "tree string, node long, parent long, role string, text string, score double")
    r = chat.read_back(chat.format_trees(df)).first()
    assert [t["text"] for t in r["turns"]] == [str(i) for i in range(70)]


def test_control_strings_come_back(spark):
    rows = [(k, i, role, text) for k, role in enumerate(("assistant", "user", "a:b<c\\#", "", None)) for i, text in enumerate(HARD)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_trees(chat.as_messages(df))).collect():
        k = int(r["tree"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(rows[k * len(HARD)][2] or "", x or "") for x in HARD]
        assert r["learned"] == ("".join(x or "" for x in HARD) if k == 0 else "")
        assert r["formatted"].count("</turn>\n") == len(HARD)


def test_query_digests(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", None), (2, None, None, "x")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, node string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op2_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, None, -7}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    hard = HARD[0]
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert got[-7]["loss_chars"] == len(hard) and got[-7]["loss_sha256"] == hashlib.sha256(hard.encode()).hexdigest()


def test_no_rows(spark):
    df = spark.createDataFrame([], "tree string, node long, parent long, role string, text string, score double")
    assert chat.format_trees(df).count() == 0


def test_bushy_trees_write_chosen_paths_only(spark):
    rng = random.Random(3)
    rows = []
    for t in range(6):
        for i in range(60):
            rows.append((f"t{t}", i, rng.randrange(max(0, i - 4), i) if i else None, "user", f"{t}.{i}", float(rng.randint(0, 9))))
    parent = {(r[0], r[1]): r[2] for r in rows}
    score = {(r[0], r[1]): r[5] for r in rows}
    want = {}
    for tree, node in sorted(set(parent) - {(t, p) for (t, _), p in parent.items()}):
        path = [node]
        while parent[tree, path[-1]] is not None:
            path.append(parent[tree, path[-1]])
        want.setdefault(tree, []).append((-sum(score[tree, x] for x in path) / len(path), node, path[::-1]))
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {}
    for r in chat.read_back(chat.format_trees(df, branches=2)).collect():
        got.setdefault(r["tree"], {})[r["branch"]] = (-r["score"], r["leaf"], [int(t["text"].split(".")[1]) for t in r["turns"]])
    assert {t: [v[b] for b in sorted(v)] for t, v in got.items()} == {t: sorted(v)[:2] for t, v in want.items()}
    leaves, links = chat.climb(df)
    chosen = chat.choose(leaves, 2)
    assert chat.paths(chosen, links).count() == sum(len(p) for v in want.values() for *_, p in sorted(v)[:2])
