"""Problem 2: splits that keep related records together.

Records and their entities (``dup_group``, ``message_id``) form a bipartite graph. The smallest record id of each
connected set is found by iterative minimum-label propagation: in each round labels flow through both kinds
of entity and through the label held before, which makes the rounds few for long chains too. The propagation
runs over distinct entity pairs, so a hot entity's rows are aggregated before any shuffle. No round count
limits it: it ends when no label changes.

Sets are then assigned to the splits. Sets larger than ``big`` of all rows - at most 1/big of them - are placed
one by one where they lower the deviation of the label distribution most; the many small ones are cut by
row counts within strata of their rarest label, by running sums that are split into hash buckets.

Edge cases: null entities tie a row to nothing; null or unknown labels count as ``other``; labels are compared
in lower case with blanks and hyphens as ``_``; repeated rows stay together if they share an entity; an empty
table gives no rows; extra columns are ignored. Targets are normalised to sum 1; a target of 0 gets no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, small_side

LABELS = ("routine", "same_day", "emergency")  # fixed values: the labels of the desk, most frequent first
#: Sets with at least this share of all rows are placed one by one: at most 1 / BIG_SHARE of them.
BIG_SHARE = 0.0005
BUCKET_SETS = 20_000


def plain_label(label: Column) -> Column:
    """A label in one spelling; unknown ones and null are ``other``."""
    x = F.regexp_replace(F.lower(F.trim(label)), r"[\s\-]+", "_")
    return F.when(x.isin(*LABELS), x).otherwise("other")


def _lowest(edges: DataFrame, by: str) -> DataFrame:
    """Every edge takes the lowest label of its ``by``."""
    low = edges.groupBy(by).agg(F.min("lab").alias("_low"))
    return edges.join(low, by).withColumn("lab", F.least("lab", "_low")).drop("_low")


def connected(rows: DataFrame) -> DataFrame:
    """id, root of rows (id, dup_group, message_id): root is the smallest id of the connected set."""
    rows = rows.select("id", "dup_group", "message_id")
    low_g = rows.where("dup_group is not null").groupBy("dup_group").agg(F.min("id").alias("lab_g"))
    low_m = rows.where("message_id is not null").groupBy("message_id").agg(F.min("id").alias("lab_m"))
    pairs = rows.where("dup_group is not null and message_id is not null").select("dup_group", "message_id").distinct()
    edges = pairs.join(low_g, "dup_group").join(low_m, "message_id").select("dup_group", "message_id", F.least("lab_g", "lab_m").alias("lab"))
    edges = checkpointed(edges)
    while True:
        before = edges.withColumn("old", F.col("lab"))
        after = checkpointed(_lowest(_lowest(_lowest(before, "dup_group"), "message_id"), "old"))
        moved = after.where("lab < old").limit(1).count()
        edges = after.drop("old")
        if not moved:
            break
    of_g = edges.groupBy("dup_group").agg(F.min("lab").alias("lab"))
    of_m = edges.groupBy("message_id").agg(F.min("lab").alias("lab"))
    of_g = low_g.join(of_g, "dup_group", "left").select("dup_group", F.least("lab", "lab_g").alias("root"))
    of_m = low_m.join(of_m, "message_id", "left").select("message_id", F.least("lab", "lab_m").alias("root"))
    with_g = rows.where("dup_group is not null").join(of_g, "dup_group").select("id", "root")
    with_m = rows.where("dup_group is null and message_id is not null").join(of_m, "message_id").select("id", "root")
    alone = rows.where("dup_group is null and message_id is null").select("id", F.col("id").alias("root"))
    return with_g.unionByName(with_m).unionByName(alone)


def _place_big(big: list, totals: dict[str, int], targets: list[tuple[str, float]], names: list[str]) -> tuple[dict[int, str], dict]:
    """Big sets one by one, largest first, to the split whose label deviation they lower most."""
    have = {s: dict.fromkeys(names, 0) for s, _ in targets}

    def cost(s: str, share: float, extra: dict) -> float:
        return sum((have[s][k] + extra.get(k, 0) - share * totals[k]) ** 2 / (share * totals[k]) for k in names if totals[k])

    placed = {}
    for r in sorted(big, key=lambda r: (-r["n"], r["root"])):
        own = {k: r[f"n_{k}"] for k in names}
        best = min(((cost(s, w, own) - cost(s, w, {}), s) for s, w in targets if w > 0))[1]
        placed[r["root"]] = best
        for k in names:
            have[best][k] += own[k]
    return placed, have


def assign_splits(rows: DataFrame, targets: DataFrame, label_col: str = "urgency") -> DataFrame:
    """id, root, label, split_name for each row of ``rows`` (id, dup_group, message_id and the label)."""
    spark = rows.sparkSession
    names = [*LABELS, "other"]
    base = rows.select("id", "dup_group", "message_id", plain_label(F.col(label_col)).alias("label"))
    tied = checkpointed(connected(base).join(base.select("id", "label"), "id"))
    sets = checkpointed(tied.groupBy("root").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == k).alias(f"n_{k}") for k in names]))
    sums = sets.agg(F.count("*").alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(k) for k in names]).first()
    want = [(r[0], float(r[1])) for r in targets.orderBy("split_name").collect()]  # one row a split
    scale = sum(w for _, w in want) or 1.0
    want = [(s, w / scale) for s, w in want]
    least = max(2, int(BIG_SHARE * sums["n"]))
    placed, have = _place_big(sets.where(F.col("n") >= least).collect(), {k: sums[k] for k in names}, want, names)
    big = spark.createDataFrame(list(placed.items()), "root bigint, split_name string")
    # what each split still needs of each label, as cumulative shares of the small sets' strata
    cuts = []
    for k in names:
        need = [(s, max(0.0, w * sums[k] - have[s][k]) if w > 0 else 0.0) for s, w in want]
        whole = sum(x for _, x in need)
        need = need if whole > 0 else [(s, w) for s, w in want]
        whole, low = sum(x for _, x in need) or 1.0, 0.0
        last = max((i for i, (_, x) in enumerate(need) if x > 0), default=0)
        for i, (s, x) in enumerate(need):
            if x > 0:
                high = low + x / whole
                cuts.append((k, s, low, 2.0 if i == last else high))
                low = high
    cut = spark.createDataFrame(cuts, "stratum string, split_name string, low double, high double")
    rarest = F.coalesce(*[F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in ("emergency", "same_day", "other", "routine")])
    buckets = max(8, sums["sets"] // BUCKET_SETS)
    small = sets.where(F.col("n") < least).select("root", "n", rarest.alias("stratum"), F.xxhash64("root").alias("h"))
    small = small.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    per = small.groupBy("stratum", "bucket").agg(F.sum("n").alias("in_bucket"))
    w = Window.partitionBy("stratum").orderBy("bucket")  # one row a bucket
    per = per.select("stratum", "bucket", (F.sum("in_bucket").over(w) - F.col("in_bucket")).alias("before"), F.sum("in_bucket").over(Window.partitionBy("stratum")).alias("whole"))
    small = small.join(small_side(per), ["stratum", "bucket"])
    run = F.sum("n").over(Window.partitionBy("stratum", "bucket").orderBy("h", "root").rowsBetween(Window.unboundedPreceding, 0))
    small = small.withColumn("at", (F.col("before") + run - F.col("n") / 2) / F.col("whole"))
    small = small.join(F.broadcast(cut), "stratum").where("at >= low and at < high").select("root", "split_name")
    return tied.join(big.unionByName(small), "root").select("id", "root", "label", "split_name")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows and share of each split and label, beside the target."""
    per = assigned.groupBy("split_name", "label").agg(F.count("*").alias("n_rows"))
    per = per.withColumn("label_total", F.sum("n_rows").over(Window.partitionBy("label")))
    return per.join(F.broadcast(targets), "split_name").select("split_name", "label", "n_rows", (F.col("n_rows") / F.col("label_total")).alias("share_of_label"), "target_share")
