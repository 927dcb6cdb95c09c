"""Chat formatting of reply trees (native: DataFrame functions only).

A message has a tree, a node id, a parent (null: a root), a role, a text and a score. Iterative self-joins over
doubling ancestor links give every leaf's mean score, by which the branches of a tree are ranked, and then the chosen
root-to-leaf paths, each in about log2(depth) joins; each is formatted as one conversation with a loss mask over its
assistant texts.

A turn is ``### role: text</turn>`` and a line feed. In roles and texts a backslash becomes two, ``<`` becomes
``\\l``, ``#`` becomes ``\\h``, and in roles ``:`` becomes ``\\c``, so that no text can hold a control string.

Null roles and texts count as empty, null scores as 0. A parent that is not in its tree counts as none; messages
that lead into a cycle have no root and take no part. Repeated (tree, node) rows count once. No messages give no
conversations. Very long texts are taken whole, a conversation within one row. Other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, table

END = "</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(c, F.lit(":"), F.lit("\\c")) if role else c


def unescape(c: Column, role: bool = False) -> Column:
    """Between doubled backslashes, taken from the left, every backslash begins one of the other escapes."""

    def part(x: Column) -> Column:
        x = F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
        return F.replace(x, F.lit("\\c"), F.lit(":")) if role else x

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def climb(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, leaf, score), the mean score of each leaf's path, and the link tables.

    ``messages`` has tree, node, parent, score. Link table k holds the 2^k-th ancestor of each message and the sum of
    the scores below it, made by joining table k-1 with itself. A path's length is a sum of powers of two, so a leaf
    that goes up the tables from the largest takes each at most once: one row a leaf, no path is written.
    """
    nodes = messages.select("tree", "node", "parent", "score").dropDuplicates(["tree", "node"])
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    nodes = cut(nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"))
    n, links, k = nodes.count(), [], 0
    link = nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("above"), F.col("score").alias("below"))
    while not link.isEmpty() and k <= math.ceil(math.log2(n + 1)):
        links.append(link)
        low, high = link.alias("a"), link.alias("b")
        step = (F.col("a.tree") == F.col("b.tree")) & (F.col("a.above") == F.col("b.node"))
        link, k = cut(low.join(high, step).select("a.tree", "a.node", "b.above", (F.col("a.below") + F.col("b.below")).alias("below"))), k + 1
    if k > math.ceil(math.log2(n + 1)):  # links longer than any path run in circles
        loose = link.select("tree", "node").distinct()
        nodes = nodes.join(loose, ["tree", "node"], "left_anti")
        links = [x.join(loose, ["tree", "node"], "left_anti") for x in links]
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    at = nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("total"), F.lit(1).cast("long").alias("size"))
    for k in reversed(range(len(links))):
        up = F.when(F.col("above").isNotNull(), F.lit(2**k)).otherwise(F.lit(0))
        at = at.join(links[k], ["tree", "node"], "left").select("tree", "leaf", F.coalesce("above", "node").alias("node"), (F.col("total") + F.coalesce("below", F.lit(0.0))).alias("total"), (F.col("size") + up).alias("size"))
    at = at.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    return cut(at.select("tree", "leaf", ((F.col("total") + F.col("score")) / F.col("size")).alias("score"))), links


def choose(leaves: DataFrame, branches: int | None) -> DataFrame:
    """leaves with branch: the paths of each tree, best mean score first, ties to the smaller leaf id."""
    ranked = leaves.withColumn("branch", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return ranked.where(F.col("branch") <= branches) if branches else ranked


def paths(leaves: DataFrame, links: list[DataFrame]) -> DataFrame:
    """(tree, leaf, node, up) for each message on the paths of the given leaves; up: steps above the leaf.

    Joining the paths so far with each link table in turn reaches every ancestor once.
    """
    out = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, link in enumerate(links):
        higher = out.join(link, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + 2**k).alias("up"))
        out = cut(out.unionByName(higher))
    return out


def format_trees(messages: DataFrame, branches: int | None = 1, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, branch, score, formatted, loss): loss is an array of (start, end) code points, from 0, end out.

    ``messages``: tree, node, parent, role, text, score; other columns are ignored. ``branches``: how many of each
    tree's paths are kept (None: all).
    """
    m = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = m.where("tree is not null and node is not null").dropDuplicates(["tree", "node"])
    leaves, links = climb(m)
    chosen = cut(choose(leaves, branches))
    turns = paths(chosen, links).join(chosen, ["tree", "leaf"]).join(m.drop("score", "parent"), ["tree", "node"])
    head = F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": "))
    turns = turns.select("tree", "leaf", "branch", "score", (-F.col("up")).alias("at"), head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == learn).alias("learn"))
    before = W.partitionBy("tree", "leaf").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start).withColumn("end", F.col("start") + F.length("body"))
    listed = turns.groupBy("tree", "leaf").agg(F.first("branch").alias("branch"), F.first("score").alias("score"), F.array_sort(F.collect_list(F.struct("at", "head", "body", "learn", "start", "end"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    text = F.concat(F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""))
    return listed.select("tree", "leaf", "branch", "score", text.alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns, an array of (role, text), and learned, the unescaped text under the loss mask, from formatted and loss alone."""
    pieces = F.split(F.col("formatted"), END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        return F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(5)), ": ", 1), True).alias("role"),
            unescape(F.substr(x, F.instr(x, ": ") + 2)).alias("text"),
        )

    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    return formatted.withColumns({"turns": F.transform(pieces, turn), "learned": learned})


def as_messages(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row's parent is the row before it by turn (ties: role, text)."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(w).cast("long"))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return rows.select(tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op2_chat_formatting(spark, sf_dir):
    hard = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = read_back(format_trees(as_messages(rows), branches=1))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.expr("try_cast(tree as bigint)").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', ''))
    + length(text) - length(replace(text, '#', '')) AS body,
    length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', ''))
    + length(role) - length(replace(role, '#', '')) + length(role) - length(replace(role, ':', '')) AS head
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + head + 2 + body + 8)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
