"""Retraining as one plan: resolve conflicts upward, score out of fold, fit, find the threshold on all messages, write a version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LABELS, plain_label, rank
from ..operators import metrics, model


def most_urgent(rows: DataFrame) -> DataFrame:
    """One row a core_hash: that with the most urgent label, the first of equals. Rows without either drop out."""
    known = rows.withColumn("label", plain_label(F.col("label"))).where("label IS NOT NULL AND core_hash IS NOT NULL")
    best = known.groupBy("core_hash").agg(F.max_by(F.struct(*known.columns), F.struct(rank(F.col("label")), -F.col("row_id"))).alias("_r"))
    return best.select("_r.*")


def retrain(rows: DataFrame, folder: str, folds: int = 5, messages: DataFrame | None = None) -> dict:
    """Fit on rows (row_id, core_hash, body, label), save a version under ``folder`` and return its configuration.

    The threshold fits the budget on ``messages`` (body), repeats included, or on all rows, labelled or not; each text is
    scored once, by the final model. The flagged rows are counted by their out-of-fold scores.
    """
    train = most_urgent(rows)
    scores = model.out_of_fold(train, folds).select("row_id", "label", F.col("p_urgent").alias("p"))
    fitted = model.fit(train)
    traffic = (rows if messages is None else messages).groupBy("body").agg(F.count("*").alias("n"))
    threshold = metrics.alert_threshold(model.scored(fitted, traffic), "p_urgent", messages="n").first().threshold
    over = F.col("p") >= (threshold if threshold is not None else 2.0)
    found = scores.agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == x).alias(x) for x in LABELS], *[F.count_if((F.col("label") == x) & over).alias(f"{x}_flagged") for x in LABELS]).first()
    config = {"train_rows": found.n, "class_counts": {x: found[x] for x in LABELS}, "threshold": threshold, "flagged": {x: found[f"{x}_flagged"] for x in LABELS}}
    config["version"] = model.save(fitted, folder, config)
    return config
