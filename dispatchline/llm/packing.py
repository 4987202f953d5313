"""Problem 6: filling containers of fixed capacity with documents, by a grouping genetic algorithm on islands.

A chromosome groups the items of one shard into containers. Crossover injects whole well-filled containers of
one parent into the other, removes the containers that hold any of their items, and puts the displaced items back
by best fit, largest first; mutation dissolves the emptiest containers. Shards have a bounded number of items,
so the work grows in proportion to the items; each shard is evolved by several islands, whose elites move to the next
island between epochs through a join. Containers that stay underfilled after the epochs are dissolved and their
items dealt to new shards for another round, so that what is left in one shard meets that of others.

A text longer than the capacity is cut into full containers and one remainder; nothing else is split.

Edge cases: texts without tokens (null, empty) need no room and come out with a null container; items of equal size
are told apart by their ids; repeated doc_ids are told apart by ``piece_no`` only if they are rows of their own,
which is why doc_id must be unique; an empty table gives no rows; capacities below 1 are refused; extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

SHARD_ITEMS, ISLANDS, EPOCHS, ROUNDS = 400, 2, 2, 3
POPULATION, GENERATIONS = 6, 10
#: Containers filled less than this are dissolved between rounds.
UNDERFILLED = 0.97


def _best_fit(sizes: np.ndarray, items: np.ndarray, room: list[int], cap: int, out: np.ndarray) -> None:
    """Put items, largest first, where they leave least room; room is that of the open containers."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    n = len(room)
    for i in items[np.argsort(-sizes[items], kind="stable")]:
        s = int(sizes[i])
        at = bisect_left(free, (s, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b, n = cap, n, n + 1
        out[i] = b
        if r > s:
            insort(free, (r - s, b))


def _fills(sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    return np.bincount(groups, weights=sizes)


def _fitness(sizes: np.ndarray, groups: np.ndarray, cap: int) -> float:
    f = _fills(sizes, groups)
    f = f[f > 0]
    return float(np.mean((f / cap) ** 2))


def _rebuild(sizes: np.ndarray, kept: np.ndarray, loose: np.ndarray, cap: int) -> np.ndarray:
    """A chromosome from the kept containers (-1: none) and loose items put back by best fit."""
    out = np.full(len(sizes), -1, np.int64)
    held = kept >= 0
    _, out[held] = np.unique(kept[held], return_inverse=True)
    room = list((cap - _fills(sizes[held], out[held])).astype(np.int64)) if held.any() else []
    _best_fit(sizes, loose, room, cap, out)
    return out


def _cross(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, rng: np.random.Generator) -> np.ndarray:
    fill = _fills(sizes, b)
    good = np.argsort(-fill, kind="stable")[: max(1, int(len(fill) * rng.uniform(0.2, 0.6)))]
    take = np.zeros(len(fill), bool)
    take[good[rng.random(len(good)) < 0.7]] = True
    injected = take[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[injected]] = True
    kept = np.where(injected, b + a.max() + 1, np.where(hit[a], -1, a))
    return _rebuild(sizes, kept, np.flatnonzero(kept < 0), cap)


def _mutate(sizes: np.ndarray, a: np.ndarray, cap: int, rng: np.random.Generator) -> np.ndarray:
    fill = _fills(sizes, a)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill, kind="stable")[: max(2, int(len(fill) * 0.1))]] = True
    gone |= rng.random(len(fill)) < 0.03
    kept = np.where(gone[a], -1, a)
    return _rebuild(sizes, kept, np.flatnonzero(kept < 0), cap)


def _evolve(sizes: np.ndarray, population: list[np.ndarray], cap: int, seed: int) -> list[np.ndarray]:
    """Some generations of one island; the best chromosome comes first."""
    rng = np.random.default_rng(seed)
    everything = np.arange(len(sizes))
    while len(population) < POPULATION:
        # a random part is left to best fit last, which gives unlike starts
        first = everything[rng.random(len(sizes)) < rng.uniform(0.3, 1.0)] if population else everything
        start = _rebuild(sizes, np.full(len(sizes), -1), first, cap)
        population.append(_rebuild(sizes, start, np.flatnonzero(start < 0), cap))
    least = int(np.ceil(sizes.sum() / cap))
    score = [_fitness(sizes, p, cap) for p in population]
    for _ in range(GENERATIONS):
        order = np.argsort(score)[::-1]
        population, score = [population[i] for i in order], [score[i] for i in order]
        if len(np.unique(population[0])) <= least:
            break
        for _ in range(2):
            i, j = sorted(rng.choice(len(population), 2, replace=False))
            child = _cross(sizes, population[j], population[i], cap, rng)
            if rng.random() < 0.5:
                child = _mutate(sizes, child, cap, rng)
            s = _fitness(sizes, child, cap)
            worst = int(np.argmin(score))
            if s > score[worst]:
                population[worst], score[worst] = child, s
    order = np.argsort(score)[::-1]
    return [population[i] for i in order]


STATE = "pack_name string, capacity int, shard bigint, island int, ids array<bigint>, pieces array<int>, sizes array<int>, population array<array<int>>"


def _epoch(number: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                sizes = np.asarray(r.sizes, np.int64)
                now = [np.asarray(p, np.int64) for p in r.population]
                if r.migrant is not None and now:
                    now[-1] = np.asarray(r.migrant, np.int64)
                out.append([p.astype(np.int32) for p in _evolve(sizes, now, r.capacity, hash((int(r.shard), int(r.island), number)) & 0x7FFFFFFF)])
            yield pdf.drop(columns="migrant").assign(population=out)

    return run


def _pack_round(items: DataFrame, number: int) -> DataFrame:
    """pack_name, capacity, doc_id, piece_no, n_tokens, container of the items dealt to shards and evolved."""
    per = items.groupBy("pack_name").agg(F.greatest(F.lit(1), F.floor((F.count("*") + SHARD_ITEMS - 1) / SHARD_ITEMS)).alias("_shards"))
    dealt = items.join(F.broadcast(per), "pack_name").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(number)), F.col("_shards")))
    # one row a shard: SHARD_ITEMS on average bound the row
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "piece_no", "n_tokens")))
    shards = dealt.groupBy("pack_name", "capacity", "shard").agg(rows.alias("r"))
    state = shards.select("pack_name", "capacity", "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("r.doc_id").alias("ids"), F.col("r.piece_no").alias("pieces"), F.col("r.n_tokens").cast("array<int>").alias("sizes"), F.expr("cast(array() as array<array<int>>)").alias("population"))
    # a shard's work is far larger than its data, so the partitions aren't left to be merged by their size
    spark = items.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    state = state.repartition(tasks, "pack_name", "shard", "island")
    none = F.expr("cast(null as array<int>)").alias("migrant")
    for epoch in range(EPOCHS):
        if epoch:
            elite = state.select("pack_name", "shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("population")[0].alias("migrant"))
            state = state.join(elite, ["pack_name", "shard", "island"], "left")
        else:
            state = state.select("*", none)
        columns = [c.split(" ")[0] for c in STATE.split(", ")]
        state = checkpointed(state.select(*columns, "migrant").mapInPandas(_epoch(number * EPOCHS + epoch), STATE))
    best = F.col("population")[0]
    state = state.withColumn("used", F.size(F.array_distinct(best)))
    chosen = state.groupBy("pack_name", "capacity", "shard").agg(F.min_by(F.struct("ids", "pieces", "sizes", best.alias("groups")), F.struct("used", "island")).alias("x"))
    flat = chosen.select("pack_name", "capacity", "shard", F.explode(F.arrays_zip("x.ids", "x.pieces", "x.sizes", "x.groups")).alias("z"))
    name = F.concat_ws("-", "pack_name", F.lit(number), "shard", "z.groups")
    return flat.select("pack_name", "capacity", F.col("z.ids").alias("doc_id"), F.col("z.pieces").alias("piece_no"), F.col("z.sizes").cast("bigint").alias("n_tokens"), name.alias("container_id"))


def pieces_of(counted: DataFrame, packs: DataFrame) -> DataFrame:
    """Every document as pieces for each capacity: pack_name, capacity, doc_id, piece_no, n_tokens."""
    p = packs.select("pack_name", F.col("capacity_tokens").cast("int").alias("capacity"))
    p = p.withColumn("capacity", F.when(F.col("capacity") >= 1, F.col("capacity")).otherwise(F.raise_error(F.lit("a capacity must be at least 1")).cast("int")))
    x = counted.where("n_tokens > 0").crossJoin(F.broadcast(p))  # a few rows of capacities
    last = F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int")
    x = x.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    return x.select("pack_name", "capacity", "doc_id", "piece_no", F.least(F.col("capacity").cast("bigint"), F.col("n_tokens") - F.col("piece_no").cast("bigint") * F.col("capacity")).alias("n_tokens"))


def pack(counted: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, container_id, doc_id, piece_no, n_tokens of counted (doc_id, n_tokens) for each capacity."""
    items = pieces_of(counted, packs)
    columns = ["pack_name", "container_id", "doc_id", "piece_no", "n_tokens"]
    full = items.where("n_tokens = capacity").withColumn("container_id", F.concat_ws("-", "pack_name", F.lit("full"), "doc_id", "piece_no")).select(*columns)
    done = [full]
    rest = checkpointed(items.where("n_tokens < capacity"))
    for number in range(ROUNDS):
        packed = _pack_round(rest, number)
        if number == ROUNDS - 1:
            done.append(packed.select(*columns))
            break
        fill = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
        packed = checkpointed(packed.join(fill, "container_id"))
        settled = F.col("fill") >= F.col("capacity") * UNDERFILLED
        done.append(packed.where(settled).select(*columns))
        rest = packed.where(~settled).select("pack_name", "capacity", "doc_id", "piece_no", "n_tokens")
    empty = counted.where("n_tokens = 0").crossJoin(F.broadcast(packs.select("pack_name")))
    done.append(empty.select("pack_name", F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), "n_tokens"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def packing_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """For each capacity: pieces, containers, the least number that tokens alone would need, and the share filled."""
    by = packed.where("container_id is not null").groupBy("pack_name", "container_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"))
    by = by.groupBy("pack_name").agg(F.sum("k").alias("n_pieces"), F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    by = by.join(F.broadcast(packs), "pack_name")
    return by.select("pack_name", "capacity_tokens", "n_pieces", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), "n_tokens", "fullest", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("filled"))
