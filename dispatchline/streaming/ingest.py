"""Streaming ingest: messages arrive as files, are kept once, hashed, answered from the cache and raised by rules."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import body_hash, plain_label
from ..operators import rules, store


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over parquet files of messages, a folder or one file, with the schema of those that are there."""
    schema = spark.read.parquet(path).schema
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        return stream.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return stream.parquet(path)


def ingest(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """Messages with the cached answer and the label after the rules; ``run_once`` keeps each once.

    Messages without an answer come out with null labels.
    """
    m = messages.select("row_id", "message_id", F.col("created_at").cast("timestamp").alias("created_at"), "body", body_hash(F.col("body")).alias("body_hash"))
    a = answers.select("body_hash", plain_label(F.col("llm_urgency")).alias("label"))
    hits = rules.hits(F.col("body"))
    return m.join(a, "body_hash", "left").select("row_id", "message_id", "created_at", "body_hash", "label", F.array_join(hits, ",").alias("rule_hits"), rules.floor_label(hits, F.col("label")).alias("final_label"))


def run_once(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process what is there and stop; a second call with the same checkpoint adds only what is new.

    Each message_id is written once however late it comes: that of the first micro-batch, there the lowest row_id. Rows
    without an id can't be told apart and all stay. Each batch is compared with all ids already written; it has a folder
    of its own, so that a batch that is run again replaces itself.
    """
    run = "r" + hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        rows = store.keep_first(batch, "message_id", "row_id")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            written = spark.read.schema("message_id string, run string, batch bigint").parquet(target)
            rows = rows.join(written.where((F.col("run") != run) | (F.col("batch") < number)).select("message_id"), "message_id", "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
