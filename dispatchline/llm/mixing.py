"""Problem 7: mixing sources to target shares of tokens, by entropy balancing.

Rates r of the documents stay as near to one as possible (least relative entropy) while the tokens of each source
reach its target and no rate exceeds the source's cap. The solution has the form min(cap, exp(lambda * tokens)) with
one lambda a source; the lambdas solve a convex dual by Newton steps, each of which sums over the distributed
histogram of (source, tokens), so a step's work doesn't grow with hot sources. Rates are then rounded to copies by
systematic rounding along the documents of a source sorted by length, which keeps the tokens of the source within
about one document of its target; single copies of documents of fitting length then close that gap.

The size of the mix is ``total_tokens`` or else the largest at which every source can reach its share under its cap.

Edge cases: source names are compared in lower case with blanks and hyphens as ``_``; null sources and sources without
a target take no part; targets without any token (``fax_archive``) can't be reached, their share falls to the others in
proportion and the report shows 0; documents without tokens are never drawn; a cap below 1 excludes a source; repeated
rows are documents of their own; empty tables give an empty mix; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

NEWTON_STEPS, CLOSE_ENOUGH = 200, 1e-9
#: Relative gap of a source's tokens beyond which a solution isn't accepted.
ACCEPTED = 1e-6
BUCKET_DOCS = 200_000
#: Rounds of single changes that close what rounding left open, until the gap is below GAP of the source's target.
FIXES, GAP = 8, 5e-4


def plain_source(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def _rate(lam: Column, cap: Column, scaled: Column) -> Column:
    return F.when(lam.isNull(), cap).otherwise(F.least(cap, F.exp(F.least(lam * scaled, F.lit(50.0)))))


def solve(hist: DataFrame, want: dict[str, tuple[float, float, float]]) -> dict[str, float | None]:
    """lambda of each source (None: every rate at its cap) for want: source -> (tokens, cap, mean length).

    hist: source, n_tokens, n. The dual's gradient and curvature come from one aggregation a step; a step that
    leaves the bracket of the root is replaced by its middle. As many numbers as sources pass through the driver. A
    source whose gap is above ACCEPTED after the last step is an error.
    """
    spark = hist.sparkSession
    lam = dict.fromkeys(want, 0.0)
    low, high = dict.fromkeys(want, -math.inf), dict.fromkeys(want, math.inf)
    left, gaps = set(want), {}
    for _ in range(NEWTON_STEPS):
        if not left:
            break
        now = spark.createDataFrame([(s, lam[s], want[s][1], want[s][2]) for s in sorted(left)], "source string, lam double, cap double, mean double")
        x = hist.join(F.broadcast(now), "source")
        scaled = F.col("n_tokens") / F.col("mean")
        r = _rate(F.col("lam"), F.col("cap"), scaled)
        sums = x.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens") * r).alias("g"), F.sum(F.when(r < F.col("cap"), F.col("n") * F.col("n_tokens") * scaled * r).otherwise(0.0)).alias("h"))
        for s, g, h in sums.collect():
            gap = gaps[s] = g - want[s][0]
            if abs(gap) <= CLOSE_ENOUGH * max(1.0, want[s][0]):
                left.discard(s)
                continue
            if gap > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - gap / h if h > 0 else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s]) and math.isfinite(high[s]) else lam[s] + (-1.0 if gap > 0 else 1.0) * max(1.0, abs(lam[s]))
            lam[s] = step
    if off := [s for s in left if abs(gaps[s]) > ACCEPTED * max(1.0, want[s][0])]:
        raise ValueError(f"no rates found for {', '.join(sorted(off))} in {NEWTON_STEPS} steps")
    return lam


def mix(counted: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, rate, n_copies of counted (doc_id, source, n_tokens); documents not drawn have 0 copies."""
    spark = counted.sparkSession
    docs = checkpointed(counted.where("n_tokens > 0").select("doc_id", plain_source(F.col("source")).alias("source"), "n_tokens"))
    goal = {r[0]: (float(r[1]), float(r[2])) for r in targets.select(plain_source(F.col("source")), "target_share", "max_repeats").collect() if r[0] and r[1] and r[1] > 0 and r[2] and r[2] >= 1}  # a row a source
    named = docs.where(F.col("source").isin(*goal) if goal else F.lit(False))
    hist = checkpointed(named.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    have = {r[0]: (float(r[1]), r[2]) for r in hist.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")), F.sum("n")).collect()}
    share = sum(goal[s][0] for s in have) or 1.0
    most = min((goal[s][1] * have[s][0] / (goal[s][0] / share) for s in have), default=0.0)
    size = most if total_tokens is None else min(float(total_tokens), most)
    want, full = {}, []
    for s, (tokens, n) in have.items():
        t = size * goal[s][0] / share
        if t >= goal[s][1] * tokens * (1 - 1e-12):
            full.append(s)  # every document at its cap
        else:
            want[s] = (t, goal[s][1], tokens / n)
    lam = solve(hist, want) | dict.fromkeys(full)
    rates = spark.createDataFrame([(s, lam[s], goal[s][1], have[s][0] / have[s][1]) for s in sorted(have)], "source string, lam double, cap double, mean double")
    buckets = max(1, int(sum(n for _, n in have.values())) // BUCKET_DOCS)
    x = named.join(F.broadcast(rates), "source").withColumn("rate", _rate(F.col("lam"), F.col("cap"), F.col("n_tokens") / F.col("mean")))
    x = x.withColumns({"_h": F.xxhash64("doc_id"), "_b": F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(buckets))})
    cells = checkpointed(x.groupBy("source", "n_tokens", "_b").agg(F.sum("rate").alias("_sum")))
    w = Window.partitionBy("source").orderBy("n_tokens", "_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select("source", "n_tokens", "_b", (F.sum("_sum").over(w) - F.col("_sum")).alias("_before"))
    x = x.join(cells, ["source", "n_tokens", "_b"])
    k = F.row_number().over(Window.partitionBy("source", "n_tokens", "_b").orderBy("_h", "doc_id"))
    end = F.col("_before") + k * F.col("rate") + 0.5
    copies = F.least(F.col("cap"), F.floor(end + 1e-7) - F.floor(end - F.col("rate") + 1e-7)).cast("int")
    rounded = checkpointed(x.select("doc_id", "source", "n_tokens", "rate", F.col("cap").cast("int").alias("cap"), copies.alias("n_copies")))
    changes = _closing_changes(rounded, {s: want[s][0] for s in want})
    if changes:
        c = spark.createDataFrame(changes, "doc_id bigint, _more int")  # at most FIXES rows a source
        rounded = rounded.join(F.broadcast(c), "doc_id", "left").withColumn("n_copies", F.col("n_copies") + F.coalesce("_more", F.lit(0)))
    return rounded.select("doc_id", "source", "n_tokens", "rate", "n_copies")


def _closing_changes(rounded: DataFrame, want: dict[str, float]) -> list[tuple[int, int]]:
    """Single copies added or taken away, of the documents whose length fits the gap that rounding left best."""
    spark = rounded.sparkSession
    gaps = {s: want[s] - t for s, t in rounded.where(F.col("source").isin(*want)).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies"))).collect()} if want else {}
    changes: list[tuple[int, int]] = []
    for _ in range(FIXES):
        open_gaps = [(s, float(g)) for s, g in gaps.items() if abs(g) > GAP * want[s]]
        if not open_gaps:
            break
        x = rounded.join(F.broadcast(spark.createDataFrame(open_gaps, "source string, gap double")), "source")
        x = x.where(((F.col("gap") > 0) & (F.col("n_copies") < F.col("cap")) | (F.col("gap") < 0) & (F.col("n_copies") > 0)) & ~F.col("doc_id").isin(*[d for d, _ in changes]))
        best = F.min_by(F.struct("doc_id", "n_tokens"), F.struct(F.abs(F.col("n_tokens") - F.abs("gap")), "doc_id"))
        before = len(changes)
        for s, r in x.groupBy("source").agg(best).collect():
            sign = 1 if gaps[s] > 0 else -1
            if abs(gaps[s] - sign * r["n_tokens"]) < abs(gaps[s]):
                gaps[s] -= sign * r["n_tokens"]
                changes.append((r["doc_id"], sign))
        if len(changes) == before:
            break
    return changes


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: tokens drawn, the share reached and the most copies of one document."""
    by = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens_there"), F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens_drawn"), F.max("n_copies").alias("most_copies"))
    t = targets.select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    out = t.join(by, "source", "left").na.fill(0, ["n_docs", "tokens_there", "tokens_drawn", "most_copies"])
    whole = F.sum("tokens_drawn").over(Window.partitionBy())  # a row a target
    return out.withColumn("actual_share", F.col("tokens_drawn") / F.nullif(whole, F.lit(0)))
