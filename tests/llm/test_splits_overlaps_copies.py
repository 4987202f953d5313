"""Problems 2, 4 and 5 against brute force, and their edge cases."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from dispatchline.llm import copies, overlaps, splits

CORPUS = "id bigint, dup_group bigint, message_id string, urgency string"
TARGETS = [("train", 0.8), ("valid", 0.1), ("test", 0.1)]


def roots_by_hand(rows):
    parent = {r[0]: r[0] for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k in (1, 2):
        first = {}
        for r in rows:
            if r[k] is not None:
                a, b = sorted((find(first.setdefault(r[k], r[0])), find(r[0])))
                parent[b] = a
    return {r[0]: find(r[0]) for r in rows}


def test_sets_of_random_rows_and_of_a_chain(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, rng.randrange(120)]), rng.choice([None, f"m{rng.randrange(150)}"]), "routine") for i in range(300)]
    chain = [(1000 + i, 10_000 + i // 2, f"c{(i + 1) // 2}", None) for i in range(120)]
    got = {r.id: r.root for r in splits.connected(spark.createDataFrame(rows + chain, CORPUS)).collect()}
    assert got == roots_by_hand(rows + chain)
    assert {got[r[0]] for r in chain} == {1000}


def test_assignment_keeps_sets_and_shares(spark):
    rng = random.Random(2)
    rows = [(i, None if i % 7 == 0 else rng.randrange(2500), None, rng.choice(["Routine"] * 8 + ["same-day", " EMERGENCY", None, "???"])) for i in range(6000)]
    rows += [(10_000 + i, 99_999, None, "routine") for i in range(300)]
    targets = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    out = splits.assign_splits(spark.createDataFrame(rows, CORPUS), targets).collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    by_root, by_label = defaultdict(set), defaultdict(lambda: defaultdict(int))
    for r in out:
        by_root[r.root].add(r.split_name)
        by_label[r.label][r.split_name] += 1
    assert all(len(x) == 1 for x in by_root.values())
    for label, n in by_label.items():
        for s, share in TARGETS:
            assert abs(n[s] - share * sum(n.values())) <= max(6, 0.012 * len(rows)), (label, dict(n))


def test_empty_single_and_clashing_columns(spark):
    targets = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    empty = spark.createDataFrame([], CORPUS)
    assert splits.assign_splits(empty, targets).count() == 0
    odd = spark.createDataFrame([(5, None, None, None, "x", 1)] * 2, CORPUS + ", split_name string, root int")
    assert {r.split_name for r in splits.assign_splits(odd, targets).collect()} == {"train"}
    assert splits.split_report(splits.assign_splits(odd, targets), targets).count() == 1


def test_hot_group_of_a_third(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(1)).cast("bigint").alias("dup_group"), F.concat(F.lit("m"), F.col("id")).alias("message_id"), F.lit("routine").alias("urgency"))
    n = splits.connected(rows).groupBy("root").count().orderBy(F.desc("count")).first()
    assert (n.root, n["count"]) == (0, 1000)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    texts += [" ".join([*t.split()[1:], f"x{i}"]) for i, t in enumerate(texts)] + [t.upper().replace(" ", ", ") for t in texts[:20]]
    texts += [" ".join(f"long{i}" for i in range(a, a + 400)) for a in (0, 20, 60, 300)] + ["", None, "?!", "one", "One"]
    rows = [(i, t, rng.choice(["train", "valid", "TEST ", None])) for i, t in enumerate(texts)]
    b = spark.createDataFrame([(i, f"m{i}", s, None) for i, _, s in rows], "row_id bigint, message_id string, split_name string, source string")
    m = spark.createDataFrame([(i, t) for i, t, _ in rows], "row_id bigint, body string")
    c = spark.createDataFrame([("m0", 1), ("m1", 1), ("m2", None), (None, 1), ("m3", 1), ("m3", 1)], "message_id string, dup_group bigint")
    side = {i: s.strip().lower() for i, _, s in rows if s}
    words = {i: set(re.findall(r"[^\W_]+", t.lower())) if t else set() for i, t, _ in rows}
    want = set()
    for e in side:
        for t in side:
            if side[e] != "train" and side[t] == "train":
                union = words[e] | words[t]
                if words[e] and words[t] and len(words[e] & words[t]) >= 0.8 * len(union) - 1e-9 or {e, t} <= {0, 1, 3}:
                    want.add((e, t))
    got = [(r.id_eval, r.id_train) for r in overlaps.cross_split_overlaps(b, m, c).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    report = overlaps.overlap_report(b, m, c).collect()
    for s in ("valid", "test"):
        r = next(x for x in report if x.split_name == s)
        own = [e for e, _ in want if side[e] == s]
        assert (r.n_rows, r.n_leaked, r.n_pairs) == (sum(x == s for x in side.values()), len(set(own)), len(own))
    assert overlaps.cross_split_overlaps(b.where("row_id < 0"), m, c).count() == 0


def test_copies(spark):
    rows = [
        (1, "Hello, World 12"), (2, "hello\tworld-12!"), (3, "HELLO​WORLD12"), (4, "hello world 13"), (5, "Fault: no heat; Name: Bob"), (6, "name : bob\nfault: NO HEAT."), (7, "﻿Name: Bob | Fault: no heat"),
        (8, "no heat"), (9, None), (10, ""), (11, "!?"), (12, "ŁÓDŹ, Шаг"), (13, "łódź шаг"), (14, "x" * 200_000), (15, "X " * 200_000), (16, "see http://a.b; ok: x"), (17, "ok: x; see http://a.b"),
    ]
    got = {r.row_id: r.rep for r in copies.copies(spark.createDataFrame(rows, "row_id bigint, body string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 12: 12, 13: 12, 14: 14, 15: 14, 16: 16, 17: 17}
    assert copies.copies(spark.createDataFrame([], "row_id bigint, body string")).count() == 0


def test_a_run_over_many_partitions(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("t"), (F.col("id") / 7).cast("int"))).alias("body"), F.lit("k").alias("key"), F.lit(1).alias("rep"))
    want = defaultdict(list)
    for r in df.collect():
        want[r.body].append(r.row_id)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.row_id: r.rep for r in copies.copies(df).collect()}
        n = {r.row_id: r.n_copies for r in copies.collapsed(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: min(v) for v in want.values() for i in v}
    assert n == {min(v): len(v) for v in want.values()}
