"""Preparing training data as one plan: hash, split the labelled rows by group, pseudo-label the rest, write combined and train.

Pseudo labels come from the training half of the labelled rows only, by the similarity-weighted vote of the five nearest;
below ``FLOOR`` a row gets none. They are asked for those unlabelled rows that the caller names, as a search takes a
stated set of queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import core, core_hash, plain_label, rank
from ..operators import grouped, retrieval
from ..session import checkpointed

NEIGHBOURS, FLOOR = 5, 0.6  # fixed values of the vote
COLUMNS = ["row_id", "message_id", "received_at", "channel", "from_name", "body", "core_hash", "label", "label_source", "confidence", "source"]


def preprocess(rows: DataFrame, ask: Column) -> DataFrame:
    """COLUMNS of rows (row_id, message_id, received_at, channel, from_name, body, gold_label, source), combined.

    ``ask`` says which rows without a label get a pseudo label. No group of near duplicates lies in both halves.
    """
    r = checkpointed(rows.withColumns({"core_hash": core_hash(F.col("body")), "gold": plain_label(F.col("gold_label"))}))
    split = grouped.disjoint(checkpointed(grouped.halves(r, core(F.col("body")), "gold")))
    half = split.select(F.col("id").alias("row_id"), F.when(F.col("fold") == 0, "gold_train").otherwise("gold_test").alias("_half"))
    r = checkpointed(r.join(half, "row_id", "left"))
    v = retrieval.texts_of(r.select(F.col("row_id").alias("id"), F.lit(None).cast("bigint").alias("grp"), "body"))
    gold = r.where("_half = 'gold_train'").select(F.col("row_id").alias("id"), F.col("gold").alias("label"))
    asked = r.where(F.col("gold").isNull() & ask).select(F.col("row_id").alias("id"))
    near = retrieval.nearest_texts(v.join(asked, "id", "left_semi"), v.join(gold, "id", "left_semi"), NEIGHBOURS, v, FLOOR).join(gold, "id")
    votes = retrieval.vote(near, FLOOR, rank(F.col("label"))).select(F.col("query_id").alias("row_id"), F.col("label").alias("_voted"), F.col("confidence").alias("_sure"))
    out = r.join(votes, "row_id", "left")
    source = F.when(F.col("_half").isNotNull(), F.col("_half")).when(F.col("_voted").isNotNull(), "synthetic").otherwise("none")
    return out.select(*[c for c in COLUMNS[:7]], F.coalesce("gold", "_voted").alias("label"), source.alias("label_source"), F.when(F.col("gold").isNotNull(), 1.0).otherwise(F.col("_sure")).alias("confidence"), "source")


def training(combined: DataFrame) -> DataFrame:
    """Rows to train on: labelled by hand in the training half or by vote, of the messages only."""
    return combined.where((F.col("source") == "messages") & F.col("label_source").isin("gold_train", "synthetic"))


def write(combined: DataFrame, folder: str) -> None:
    """The two tables, ``combined`` and ``train``, under a folder."""
    combined.write.mode("overwrite").parquet(f"{folder}/combined")
    training(combined.sparkSession.read.parquet(f"{folder}/combined")).write.mode("overwrite").parquet(f"{folder}/train")
