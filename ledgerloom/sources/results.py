"""Truth, results and operators' decisions as files: JSON documents read by contract, and a log that is only ever added to."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a truth's chain and a result's decision hold (fixed values).
IDS = ("payment_ids", "settlement_ids", "bank_row_ids")
CHAIN = "order_id string, expected_outcome string, " + ", ".join(f"{c} array<string>" for c in IDS)
DECISION = "order_id string, outcome string, " + ", ".join(f"{c} array<string>" for c in IDS)
#: What an operator can do about a finding (fixed values).
ACTIONS = ("approve", "reject", "escalate")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, v): each file of ``path`` as one variant; v is null where it is no JSON."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.try_parse_json("value").alias("v"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, v): each line of ``path`` as one variant; blank lines are left out."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    return rows.select("file", F.try_parse_json("value").alias("v"))


def _elements(docs: DataFrame, field: str) -> DataFrame:
    """(file, at, e): the elements of each document's ``field``, or of the document where it is a list itself, in order."""
    shape = F.schema_of_variant(F.col("v"))
    whole = F.when(F.startswith(shape, F.lit("ARRAY")), F.col("v")).otherwise(F.try_variant_get(F.col("v"), f"$.{field}", "variant"))
    items = F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), F.array().cast("array<variant>"))
    return docs.where("v is not null").select("file", F.posexplode(items).alias("at", "e"))


def _typed(rows: DataFrame, schema: str, default: dict[str, str]) -> DataFrame:
    """Columns of ``schema`` from the variant e, and ``why`` it isn't one (null: it is). Other members of e are left alone."""
    shape = F.schema_of_variant(F.col("e"))
    fields = [f.split() for f in re.split(r",\s*", schema)]
    get = lambda name, t: F.try_variant_get(F.col("e"), f"$.{name}", t)
    out, wrong = [], F.when(~F.startswith(shape, F.lit("OBJECT")), "no object")
    for name, t in fields:
        value = get(name, t)
        given = get(name, "variant")
        there = given.isNotNull() & ~F.is_variant_null(given)
        told = "list of texts" if t.startswith("array") else "text"
        right = ("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<>") if t.startswith("array") else ("STRING",)
        wrong = wrong.when(there & ~F.schema_of_variant(given).isin(*right), f"{name} is no {told}")
        value = F.coalesce(value, F.array().cast(t)) if t.startswith("array") else F.coalesce(value, F.lit(default[name])) if name in default else value
        out.append(value.alias(name))
    wrong = wrong.when(F.coalesce(get("order_id", "string"), F.lit("")) == "", "no order_id")
    return rows.select("file", "at", *out, wrong.alias("why"), F.to_json("e").alias("record"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = [c for c in rows.columns if c not in ("why", "record")]
    return rows.where("why is null").select(*good), rows.where("why is not null").select("file", "at", "why", "record")


def _unread(docs: DataFrame) -> DataFrame:
    return docs.where("v is null").select("file", F.lit(None).cast("int").alias("at"), F.lit("no JSON").alias("why"), F.lit(None).cast("string").alias("record"))


def read_truth(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(truth, rejected): chains of truth documents (an object with ``chains``, or a list; with ``lines`` a chain on each line).

    truth: file, at, order_id, expected_outcome and the three lists of ids; rejected: file, at, why, record. Nothing is dropped
    silently: a chain that can't be read is a rejected row with its reason, and so is a file that is no JSON.
    """
    docs = _lines(spark, path) if lines else _documents(spark, path)
    rows = docs.where("v is not null").select("file", F.lit(0).alias("at"), F.col("v").alias("e")) if lines else _elements(docs, "chains")
    good, bad = _split(_typed(rows, CHAIN, {}))
    return good, bad.unionByName(_unread(docs))


def read_result(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, dispositions, rejected) of result documents, in either shape: an object with ``decisions`` and maybe
    ``bank_dispositions`` (a bank row's verdict by its id), or a list of decisions. A decision without an outcome says MATCHED."""
    docs = _lines(spark, path) if lines else _documents(spark, path)
    rows = docs.where("v is not null").select("file", F.lit(0).alias("at"), F.col("v").alias("e")) if lines else _elements(docs, "decisions")
    good, bad = _split(_typed(rows, DECISION, {"outcome": "MATCHED"}))
    said = F.try_variant_get(F.col("v"), "$.bank_dispositions", "map<string,string>")
    disposed = docs.where("v is not null").select(F.explode(F.coalesce(said, F.create_map().cast("map<string,string>"))).alias("bank_row_id", "disposition"))
    return good, disposed, bad.unionByName(_unread(docs))


def write_result(decisions: DataFrame, path: str) -> None:
    """Decisions (order_id, outcome, payment_id, settlement_id, bank_row_id) as one decision on each line, which ``read_result(lines=True)`` reads."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string"))).otherwise(F.array().cast("array<string>"))
    decisions.select("order_id", "outcome", one("payment_id").alias("payment_ids"), one("settlement_id").alias("settlement_ids"), one("bank_row_id").alias("bank_row_ids")).write.json(path)


def linked(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each decision on a known order (the first by file and place): order_id, outcome, expected, and what its ids get
    wrong: wrong_payments, wrong_settlements, wrong_bank_rows. An empty list asserts nothing."""
    from ledgerloom.operators.scoring import first_decision, same_items

    first = first_decision(decisions.withColumn("__order", F.struct("file", "at")), "order_id", "__order").drop("__order", "file", "at", "duplicates")
    t = truth.select("order_id", F.col("expected_outcome").alias("expected"), *[F.col(c).alias(f"true_{c}") for c in IDS])
    rows = first.join(t, "order_id")
    errors = F.array(*[F.when(~same_items(F.col(c), F.col(f"true_{c}")), F.lit(f"wrong_{c.removesuffix('_ids')}s")) for c in IDS])
    return rows.select("order_id", "outcome", "expected", F.filter(errors, lambda e: e.isNotNull()).alias("errors"), *IDS)


def _finished(spark: SparkSession, path: str) -> list[str]:
    """Batches of a log that were written whole, by their marker; listed through the file system that holds them."""
    j = spark._jvm.org.apache.hadoop.fs
    root = j.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(root) if s.isDirectory() and fs.exists(j.Path(s.getPath(), "_SUCCESS")))


def append_decisions(log: str, decisions: DataFrame, queue: DataFrame, batch: str) -> None:
    """Adds decisions (group_id, action, note, at) about findings of ``queue`` to the log, as the batch so named.

    A batch is a folder of its own that shows only once it is whole: it is written beside the log and renamed into it. A batch that is
    there already is left as it is, so a rerun changes nothing. Unknown actions and findings refuse the whole batch.
    """
    if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
        raise ValueError("a batch is named with letters, digits and hyphens")
    spark = decisions.sparkSession
    if any(p.endswith(f"/batch={batch}") for p in _finished(spark, log)):
        return
    odd = decisions.where(~F.col("action").isin(*ACTIONS) | F.col("action").isNull()).limit(1).collect()
    if odd:
        raise ValueError(f"unknown action {odd[0]['action']!r}")
    lost = decisions.join(queue.select("group_id").distinct(), "group_id", "left_anti").limit(1).collect()
    if lost:
        raise KeyError(lost[0]["group_id"])
    made = f"{log}/.making-{uuid.uuid4().hex}"
    decisions.select("group_id", "action", F.coalesce("note", F.lit("")).alias("note"), F.col("at").cast("timestamp").alias("at")).write.parquet(made)
    j = spark._jvm.org.apache.hadoop.fs
    fs = j.Path(log).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(j.Path(made), j.Path(f"{log}/batch={batch}"))


def decision_log(spark: SparkSession, log: str) -> DataFrame:
    """(batch, group_id, action, note, at) of the log's whole batches."""
    schema = "group_id string, action string, note string, at timestamp"
    out = spark.createDataFrame([], f"batch string, {schema}")
    found = _finished(spark, log)
    if not found:
        return out
    rows = spark.read.schema(schema).parquet(*found)
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=([A-Za-z0-9-]+)/", 1)).select(*out.columns)


def last_decisions(log: DataFrame) -> DataFrame:
    """(group_id, action, note, at, decided): each finding's latest decision, ties to the later batch, and how often it was decided."""
    last = log.groupBy("group_id").agg(F.max_by(F.struct("action", "note", "at"), F.struct("at", "batch", "action", "note")).alias("d"), F.count("*").alias("decided"))
    return last.select("group_id", "d.*", "decided")


def remaining(queue: DataFrame, log: DataFrame) -> DataFrame:
    """One row: findings, how many are decided (approved or rejected; what is escalated stays open), what is left and its money."""
    done = last_decisions(log).where("action in ('approve', 'reject')").select("group_id", F.lit(True).alias("done"))
    rows = queue.join(done, "group_id", "left")
    left: Column = F.col("done").isNull()
    return rows.agg(F.count("*").alias("findings"), F.count("done").alias("decided"), F.count_if(left).alias("open"), F.coalesce(F.sum(F.when(left, F.col("rupees_paise"))), F.lit(0)).alias("open_paise"))
