"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset
    (local tests) a temporary folder is used. Files survive the loss of an executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="dispatchline-checkpoint-"))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Materialise a side expected to be small and hint a broadcast only if its counted size allows.

    Beyond ``max_rows`` the frame comes back without the hint, so the join shuffles instead.
    """
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for work that costs far more than its input is large.

    A frame that already has a partition for each core comes back as it is, so that large inputs aren't shuffled. For
    scans only: counting the partitions of a frame runs the shuffles before it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


#: A key is hot with at least so many rows and this share of all; there are at most 1 / HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 200_000, 0.001


def join_hot(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of rows with a table that has one row a key, however unevenly the rows hold the keys (never null).

    The table's rows of hot keys, of which there are at most 1 / HOT_SHARE, are broadcast, and only the rows of
    other keys are shuffled. Both sides should be checkpointed, as they are read more than once.
    """
    total = rows.count()
    if total < HOT_ROWS:
        return rows.join(table, key, "left")
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = F.broadcast(checkpointed(n.where(F.col("_n") >= max(HOT_ROWS, int(HOT_SHARE * total))).select(key)))
    cold = rows.join(hot, key, "left_anti").join(table.join(hot, key, "left_anti"), key, "left")
    return cold.unionByName(rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: under ``spark.checkpoint.dir``, or a local one in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='dispatchline-')}/{name}-{uuid.uuid4().hex}"


def fenced(df: DataFrame) -> DataFrame:
    """The same rows, through ``inline``: filters above aren't rewritten with the long expressions below.

    Without it a filter on a column that is computed in several steps is pushed to the scan as one expression in which
    each step is copied wherever it is used, which outgrows the limit of generated code.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
