"""Stratified halves of labelled rows in which near duplicates stay together.

Groups are laid out by their most urgent label and then by size, and dealt out in turns (first, second, second, first), so
that neighbours of about equal size balance each other within each label. The layout is one distributed sort with a
running count of partitions; no task holds all groups.

Edge cases: rows without words form no group of their own and are one group together; rows without a known label are
left out; repeated rows are copies of one group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_label, rank
from ..session import checkpointed
from . import setjoin


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with ``pos``, their place (from 0) in the given order, which must be total."""
    laid = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_pid": F.spark_partition_id(), "_k": F.monotonically_increasing_id()}))
    sizes = laid.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_k").alias("_least"))
    before = sizes.select("_pid", "_least", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))  # a row a partition
    return laid.join(F.broadcast(before), "_pid").withColumn("pos", F.col("_before") + F.col("_k") - F.col("_least")).drop("_pid", "_k", "_least", "_before")


def halves(rows: DataFrame, words: Column, label_col: str = "label", id_col: str = "row_id") -> DataFrame:
    """id, root, fold (0 or 1) of each labelled row; ``root`` names its group of near duplicates."""
    known = checkpointed(rows.select(F.col(id_col).alias("id"), words.alias("words"), rank(plain_label(F.col(label_col))).alias("_rank")).where(F.col("_rank").isNotNull()))
    roots = setjoin.near_duplicate_groups(known, "id", F.col("words"))
    tied = checkpointed(known.select("id", "_rank").join(roots, "id", "left").withColumn("root", F.coalesce("root", F.lit(-1).cast("bigint"))))
    groups = tied.groupBy("root").agg(F.max("_rank").alias("stratum"), F.count("*").alias("n"))
    folds = numbered(groups, F.desc("stratum"), F.desc("n"), F.col("root")).select("root", F.when((F.col("pos") % 4).isin(0, 3), 0).otherwise(1).alias("fold"))
    return tied.join(folds, "root").select("id", "root", "fold")


def disjoint(rows: DataFrame, group: str = "root", fold: str = "fold") -> DataFrame:
    """The rows as they are; fails if any group lies in more than one fold."""
    torn = rows.groupBy(group).agg(F.min(fold).alias("_a"), F.max(fold).alias("_b")).where("_a <> _b").count()
    if torn:
        raise ValueError(f"{torn} groups lie in more than one fold")
    return rows
