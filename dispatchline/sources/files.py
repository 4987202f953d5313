"""Sources with explicit schemas and formats, and guarded sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LABELS, body_hash

MESSAGES_CSV = "message_id string, received_at string, channel string, from_name string, body string, urgency string"
HOLDOUT_CSV = "message_id string, received_at string, channel string, from_name string, body string"
TRAPS_CSV = "trap_id string, trap_kind string, expected string, received_at string, channel string, from_name string, body string"
#: Formats with one or two digits for day, month and hour.
DAY_FIRST, YEAR_FIRST = "d/M/yyyy H:mm:ss", "yyyy-MM-dd HH:mm"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header, quotes and line breaks in fields, read with a stated schema or not at all."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', mode="FAILFAST")


def iso(text: Column, fmt: str) -> Column:
    """The time of a text in one stated format as ISO text; null where it has another."""
    return F.date_format(F.try_to_timestamp(text, F.lit(fmt)), "yyyy-MM-dd'T'HH:mm:ss")


def only(spark: SparkSession, pattern: str) -> str:
    """The one file that a path pattern names; an error for none or several."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    if len(there) != 1:
        raise FileNotFoundError(f"{len(there)} files match {pattern}, not one")
    return there[0].getPath().toString()


def traps_csv(spark: SparkSession, path: str) -> DataFrame:
    """Hand-written hard messages with the label they should get; times are ISO already."""
    return csv(spark, path, TRAPS_CSV)


def messages_csv(spark: SparkSession, path: str) -> DataFrame:
    """The messages file: urgency becomes gold_label, received_at ISO."""
    return csv(spark, path, MESSAGES_CSV).withColumns({"received_at": iso(F.col("received_at"), DAY_FIRST), "source": F.lit("messages")}).withColumnRenamed("urgency", "gold_label")


def holdout_csv(spark: SparkSession, path: str) -> DataFrame:
    """The holdout file, which has no labels."""
    return csv(spark, path, HOLDOUT_CSV).withColumns({"received_at": iso(F.col("received_at"), YEAR_FIRST), "gold_label": F.lit(None).cast("string"), "source": F.lit("holdout")})


def union(messages: DataFrame, holdout: DataFrame) -> DataFrame:
    return messages.unionByName(holdout)


def labelled(rows: DataFrame, label_col: str) -> DataFrame:
    """Rows whose label is one of the known ones, written exactly so."""
    return rows.where(F.col(label_col).isin(*LABELS))


def predictions(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """message_id, urgency, score, reason, source of the messages (message_id, body) that have a stored answer."""
    m = messages.select("message_id", body_hash(F.col("body")).alias("body_hash"))
    return m.join(answers.select("body_hash", "urgency", "score", "reason"), "body_hash").select("message_id", "urgency", "score", "reason", F.lit("hot").alias("source"))


def write_predictions(rows: DataFrame, path: str, force: bool = False) -> None:
    """Write predictions, but never over a file that holds answers of the hot path, unless forced."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    if there and not force and spark.read.parquet(path).where("source = 'hot'").limit(1).count():
        raise FileExistsError(f"{path} holds answers of the hot path; use force to replace them")
    rows.write.mode("overwrite").parquet(path)
