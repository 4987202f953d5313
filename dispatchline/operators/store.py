"""Store semantics as DataFrame operations: keep-first inserts, upserts, cache probes, the inbox.

Null keys are never equal to each other: rows without a key are kept as they are in inserts and never hit the cache.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import body_hash
from ..session import checkpointed


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first by ``order``; rows without a key all stay. Aggregates before it shuffles."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_r")).select("_r.*")
    return first.unionByName(rows.where(F.col(key).isNull()))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Existing rows and the first new row of each key that isn't there yet."""
    fresh = keep_first(new.where(F.col(key).isNotNull()), key, order).join(existing.select(key), key, "left_anti").select(*existing.columns)
    return existing.unionByName(fresh)


def upsert_labels(rows: DataFrame, key: str, order: str, updated: tuple[str, ...]) -> DataFrame:
    """Rows applied in order: the first of a key keeps its columns, but ``updated`` come from the last."""
    keep = [c for c in rows.columns if c not in updated]
    known = rows.where(F.col(key).isNotNull())
    out = known.groupBy(key).agg(F.min_by(F.struct(*keep), F.col(order)).alias("_a"), F.max_by(F.struct(*updated), F.col(order)).alias("_b"))
    return out.select("_a.*", "_b.*").select(*rows.columns)


def next_group(rows: DataFrame, column: str = "dup_group") -> DataFrame:
    """The group id after the highest, 0 for an empty table."""
    return rows.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).alias("next_group"))


def cache_probe(messages: DataFrame, answers: DataFrame, how: str, key: str = "body_hash") -> DataFrame:
    """Messages with (``inner``/``left``) or without (``left_anti``) a stored answer."""
    return messages.join(answers, key, how)


def inbox(messages: DataFrame, answers: DataFrame, how: str = "inner") -> DataFrame:
    """Messages with their answer, to be read by score and then arrival."""
    a = answers.select("body_hash", "urgency", "score", "reason")
    return messages.select("row_id", "message_id", "body_hash", "created_at").join(a, "body_hash", how)


def by_score(score: str = "score", arrival: str = "created_at", tie: str = "row_id") -> list[Column]:
    return [F.col(score).desc_nulls_last(), F.col(arrival).asc(), F.col(tie).asc()]


def number_new_groups(rows: DataFrame, base: DataFrame, order: str, column: str = "dup_group") -> DataFrame:
    """Rows to append, each with a group id of its own after the highest of ``base``.

    Ids follow ``order`` through one sort and a running count of rows a partition; no task holds all rows.
    """
    laid = rows.sortWithinPartitions(order) if rows.rdd.getNumPartitions() == 1 else rows.repartitionByRange(order).sortWithinPartitions(order)
    laid = laid.withColumns({"_pid": F.spark_partition_id(), "_k": F.monotonically_increasing_id()})
    laid = checkpointed(laid)
    sizes = laid.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_k").alias("_least"))
    before = sizes.select("_pid", "_least", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))  # a row a partition
    out = laid.join(F.broadcast(before), "_pid").crossJoin(F.broadcast(next_group(base, column)))
    return out.withColumn(column, F.col("next_group") + F.col("_before") + F.col("_k") - F.col("_least")).drop("_pid", "_k", "_n", "_least", "_before", "next_group")


def add_labels(corpus: DataFrame, messages: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corrections (seq, message_id, urgency) applied to the retrieval pool in order of ``seq``: (pool, unknown requests).

    A text that is in the pool gets the last label given to it and the source ``override``; one that isn't is appended
    with a group of its own after the highest, keeping the message_id of its first request. Requests for a message_id that no message has come back
    apart. The pool comes out as body_hash, message_id, body, urgency, dup_group, source.
    """
    first = keep_first(messages.where("message_id IS NOT NULL").select("row_id", "message_id", "body"), "message_id", "row_id")
    found = requests.join(first, "message_id").where("body IS NOT NULL").select("seq", "message_id", "urgency", "body", body_hash(F.col("body")).alias("body_hash"))
    last = checkpointed(found.groupBy("body_hash").agg(F.max_by("urgency", "seq").alias("_urgency"), F.min_by(F.struct("message_id", "body", "seq"), "seq").alias("_first")))
    columns = ["body_hash", "message_id", "body", "urgency", "dup_group", "source"]
    there = corpus.select(*columns).join(last.select("body_hash", "_urgency"), "body_hash", "left")
    there = there.withColumns({"urgency": F.coalesce("_urgency", "urgency"), "source": F.when(F.col("_urgency").isNotNull(), F.lit("override")).otherwise(F.col("source"))}).select(*columns)
    new = last.join(corpus.select("body_hash"), "body_hash", "left_anti").select("body_hash", "_first.*", F.col("_urgency").alias("urgency"), F.lit("override").alias("source"))
    new = number_new_groups(new, corpus, "seq").withColumn("dup_group", F.col("dup_group").cast("bigint")).select(*columns)
    return there.unionByName(new), requests.join(first.select("message_id"), "message_id", "left_anti")


def lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key, read with the filter pushed to the scan; null finds nothing."""
    return rows.where(F.col(key) == F.lit(value))
