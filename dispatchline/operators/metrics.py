"""Evaluation: confusion matrices, recall with Wilson intervals, scoreboards, disagreements, alert budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LABELS, rank

Z = 1.96  # fixed value: the normal quantile of the intervals
PER_DAY, BUDGET = 90, 10  # fixed values: messages and alerts a day


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 1) without observations."""
    p, z2 = F.try_divide(k, n), F.lit(Z * Z)
    centre = p + F.try_divide(z2, 2 * n)
    half = Z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(z2, 4 * n * n))
    scale = 1 + F.try_divide(z2, n)
    low, high = F.try_divide(centre - half, scale), F.try_divide(centre + half, scale)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), high))


def confusion(pairs: DataFrame) -> DataFrame:
    """All nine cells of true against predicted label of pairs (truth, predicted), zeros included."""
    spark = pairs.sparkSession
    cells = spark.createDataFrame([(a, b) for a in LABELS for b in LABELS], "truth string, predicted string")
    n = pairs.where(F.col("truth").isin(*LABELS) & F.col("predicted").isin(*LABELS)).groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    return cells.join(n, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def recall(pairs: DataFrame) -> DataFrame:
    """Hits, size, recall and its interval of each true label."""
    per = pairs.where(F.col("truth").isin(*LABELS)).groupBy("truth").agg(F.count_if(F.col("truth") == F.col("predicted")).alias("hits"), F.count("*").alias("n"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return per.select("truth", "hits", "n", F.round(F.try_divide(F.col("hits"), F.col("n")), 6).alias("recall"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def scoreboard(long: DataFrame) -> DataFrame:
    """One row a system of long (system, truth, predicted): accuracy, recalls, false alarms."""
    t, p = F.col("truth"), F.col("predicted")
    of = lambda x: F.count_if(t == x)
    hit = lambda x: F.count_if((t == x) & (p == x))
    return (
        long.where(t.isin(*LABELS))
        .groupBy("system")
        .agg(F.count("*").alias("n"), F.round(F.avg((t == F.coalesce(p, F.lit(""))).cast("int")), 6).alias("accuracy"), hit("emergency").alias("emergency_hits"), of("emergency").alias("emergencies"), hit("same_day").alias("same_day_hits"), of("same_day").alias("same_days"), F.count_if((t == "routine") & (p != "routine")).alias("false_alarms"), of("routine").alias("routines"))
    )


def rank_errors(pairs: DataFrame) -> DataFrame:
    """How many predictions rank exactly, too low, too high, by how much."""
    d = rank(F.col("predicted")) - rank(F.col("truth"))
    return pairs.where(d.isNotNull()).groupBy(d.alias("off_by")).agg(F.count("*").alias("n"))


def trap_report(long: DataFrame) -> DataFrame:
    """Of long (trap_id, trap_kind, expected, body, channel, predicted) a row a trap: its predictions by channel and whether any is too low."""
    low = rank(F.col("predicted")) < rank(F.col("expected"))
    per = long.groupBy("trap_id", "trap_kind", "expected").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "predicted")))).alias("predicted"), F.coalesce(F.bool_or(low), F.lit(False)).alias("missed"), F.first(F.substring("body", 1, 120)).alias("body"))  # a few channels a trap
    return per.withColumn("body", F.when(F.col("missed"), F.col("body")))


def trap_counts(long: DataFrame) -> DataFrame:
    """channel, n, exact, under, over of long (channel, expected, predicted)."""
    d = rank(F.col("predicted")) - rank(F.col("expected"))
    return long.groupBy("channel").agg(F.count("*").alias("n"), F.count_if(d == 0).alias("exact"), F.count_if(d < 0).alias("under"), F.count_if(d > 0).alias("over"))


def alert_grid(scores: DataFrame, p: str = "p", messages: str | None = None) -> DataFrame:
    """threshold and estimated alerts a day over the grid .05, .055 ... .95.

    A row stands for as many messages as its column ``messages`` says, or for one. Rows without a score are left out.
    Scores are counted by the grid step they reach before anything is shuffled; the grid has 181 rows.
    """
    spark = scores.sparkSession
    steps = spark.range(181).select(F.col("id").cast("int").alias("step"), F.round(F.lit(0.05) + F.lit(0.005) * F.col("id"), 3).alias("threshold"))
    reached = F.floor((F.col(p) - 0.05) / 0.005 + 1e-9).cast("int")  # the last step whose threshold the score reaches
    known = scores.where(F.col(p).isNotNull()).select(F.greatest(F.lit(-1), F.least(F.lit(180), reached)).alias("reached"), (F.lit(1) if messages is None else F.col(messages)).alias("n")).groupBy("reached").agg(F.sum("n").alias("n"))
    total = known.agg(F.sum("n").alias("total"))
    over = steps.join(F.broadcast(known), F.col("reached") >= F.col("step"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("flagged"))
    return over.crossJoin(F.broadcast(total)).select("threshold", "flagged", F.round(F.try_divide(F.col("flagged"), F.col("total")) * PER_DAY, 6).alias("alerts_per_day"))


def alert_threshold(scores: DataFrame, p: str = "p", budget: float = BUDGET, messages: str | None = None) -> DataFrame:
    """The smallest threshold within the budget; null where there is none."""
    return alert_grid(scores, p, messages).where(F.col("alerts_per_day") <= budget).agg(F.min("threshold").alias("threshold"))


def share_text(k: Column, n: Column) -> Column:
    """``k/n=xx% (CI lo-hi)``; without observations ``0/0``."""
    low, high = wilson(k, n)
    whole = lambda x: F.bround(100 * x).cast("int")
    return F.when(n == 0, F.lit("0/0")).otherwise(F.format_string("%d/%d=%d%% (CI %d-%d)", k.cast("int"), n.cast("int"), whole(F.try_divide(k, n)), whole(low), whole(high)))
