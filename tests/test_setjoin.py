"""The join of word sets inside tasks: against brute force, and without moving keys."""

import random
import tracemalloc
import types
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dispatchline import queries
from dispatchline.functions import text
from dispatchline.operators import setjoin


@pytest.mark.parametrize(("threshold", "strict"), [(0.6, True), (0.5, False), (0.8, False)])
def test_near_pairs_against_brute_force(spark, monkeypatch, threshold, strict):
    monkeypatch.setattr(setjoin, "BLOCK_WORDS", 400)
    rng = random.Random(7)
    base = [[f"w{int(rng.paretovariate(0.7)) % 80}" for _ in range(rng.randrange(1, 25))] for _ in range(90)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join([*w[: len(w) * 4 // 5], f"own{i}"])) for i, w in enumerate(base)]
    rows += [(200, ""), (201, None), (202, " ".join(base[0])), (203, "only here"), (204, "a b c"), (205, "a b c d e"), (206, "a b c d"), (206, "a b c d")]
    sets = {}
    for i, t in sorted((i, t) for i, t in rows if t):
        sets.setdefault(frozenset(t.split()), i)
    want = {}
    for s, a in sets.items():
        for t, b in sets.items():
            sim = len(s & t) / len(s | t)
            if a < b and (sim > threshold if strict else sim >= threshold):
                want[a, b] = round(sim, 9)
    got, member = setjoin.encoded_sets(spark.createDataFrame(rows, "id bigint, body string"), "id", text.tokens(text.squeezed(F.col("body"))))
    assert {(r.a, r.b): round(r.similarity, 9) for r in setjoin.near_pairs(got, threshold, strict).collect()} == want
    assert setjoin.near_pairs(got, threshold, strict).count() == len(want)
    assert {r.id: r.rep for r in member.collect()} == {i: sets[frozenset(t.split())] for i, t in rows if t}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sets"))
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{k}" for k in rng.sample(range(150), 48)), ("routine", "emergency")[i % 2]) for i in range(1500)]
    rows += [(2000 + i, rows[i][1] + " more", "routine") for i in range(100)]
    spark.createDataFrame(rows, "id bigint, body string, urgency string").write.parquet(f"{at}/corpus.parquet")
    m = spark.createDataFrame([(i, b) for i, b, _ in rows], "row_id bigint, body string")
    m.write.parquet(f"{at}/messages.parquet")
    spark.createDataFrame([(i, x) for i, _, x in rows], "row_id bigint, label string").select("row_id", "label", F.lit("gold_train").alias("label_source"), F.lit("h").alias("core_hash")).write.parquet(f"{at}/combined.parquet")
    return at


@pytest.mark.parametrize(("name", "rows"), [("near_dup_groups", 1600), ("cluster_sizes", 2), ("seed_corpus", 1450), ("jaccard_pairs", 100), ("contradictory_clusters", 50), ("grouped_split", 1600)])
def test_set_join_moves_no_keys(spark, folder, name, rows):
    held = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(x.totalShuffleWrite() for x in (held.executorList(False).apply(i) for i in range(held.executorList(False).size())))
    before = written()
    assert queries.QUERIES[name](spark, folder).count() == rows
    assert written() - before < 9e5  # keys and codes took 1.5 MB and more


def test_hits_of_a_word_are_not_listed():
    rng = np.random.default_rng(5)
    words = np.sort(np.argsort(rng.random((4000, 200)), axis=1)[:, :40], axis=1).astype("<i4")
    words[3000:, :36] = words[:1000, :36]
    words[3000:, 36:] = 200 + np.arange(4)
    rep, n = np.arange(4000), np.full(4000, 40, np.int32)
    block = types.SimpleNamespace(value=(rep, n, n, zlib.compress(words.tobytes())))
    pdf = pd.DataFrame({"rep": rep, "n": n, "ids": [w.tobytes() for w in words]})
    tracemalloc.start()
    got = pd.concat(setjoin._pairs(block, 0.6, True)(iter([pdf])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(i, 3000 + i) for i in range(1000)} <= set(zip(got.a, got.b))
    assert peak < 40e6  # lists of hits took 51 MB


@pytest.mark.parametrize("few", [True, False])
def test_components_against_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(setjoin, "FOREST", 0)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(400 + i, 401 + i) for i in range(70)]
    root = {i: i for e in edges for i in e} | {900: 900}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    nodes = spark.createDataFrame([(i,) for i in root], "node bigint")
    got = setjoin.components(nodes, spark.createDataFrame(edges, "a bigint, b bigint").repartition(3))
    assert {r.node: r.root for r in got.collect()} == root


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("chain"))
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 12)), "routine") for i in range(90)] + [(100 + i, f"x{i} y{i // 2} z{i // 2} v{i // 2} u{i // 2}", ("routine", "emergency")[i % 2]) for i in range(8)]
    spark.createDataFrame(rows, "id bigint, body string, urgency string").write.parquet(f"{at}/corpus.parquet")
    spark.createDataFrame([(i, b) for i, b, _ in rows], "row_id bigint, body string").write.parquet(f"{at}/messages.parquet")
    spark.createDataFrame([(i, x) for i, _, x in rows], "row_id bigint, label string").select("row_id", "label", F.lit("gold_train").alias("label_source"), F.lit("h").alias("core_hash")).write.parquet(f"{at}/combined.parquet")
    return at


@pytest.mark.parametrize(("name", "rows"), [("cluster_sizes", 2), ("grouped_split", 98), ("seed_corpus", 1), ("contradictory_clusters", 4)])
def test_a_long_chain_takes_few_jobs(spark, chain, name, rows):
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    assert queries.QUERIES[name](spark, chain).count() == rows
    assert jobs() - before < 45  # rounds over the edges took more than a hundred


def test_pairs_do_not_depend_on_cuts(monkeypatch):
    for name, n in (("CELLS", 7), ("HITS", 5), ("SETS", 30)):
        monkeypatch.setattr(setjoin, name, n)
    rng = random.Random(6)
    sets = [sorted(rng.sample(range(25), rng.randrange(1, 12))) for _ in range(200)]
    n = np.array([len(s) for s in sets], np.int32)
    packed = [np.array(s, "<i4").tobytes() for s in sets]
    pdf = pd.DataFrame({"rep": np.arange(200), "n": n, "ids": packed})
    block = types.SimpleNamespace(value=(np.arange(200), n, n, zlib.compress(b"".join(packed))))
    got = pd.concat(setjoin._pairs(block, 0.6, True)(iter([pdf[:20], pdf[20:45], pdf[45:]])))
    want = {(a, b) for b in range(200) for a in range(b) if len({*sets[a]} & {*sets[b]}) > 0.6 * len({*sets[a]} | {*sets[b]})}
    assert len(got) == len(want)
    assert set(zip(got.a, got.b)) == want


@pytest.mark.parametrize(("name", "most"), [("seed_corpus", 700_000), ("jaccard_pairs", 400_000)])
def test_what_is_kept_of_a_run(spark, folder, tmp_path, name, most):
    old = spark.sparkContext._jsc.sc().getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    queries.QUERIES[name](spark, folder).count()
    if old.isDefined():
        spark.sparkContext.setCheckpointDir(old.get())
    kept = sum(p.stat().st_size for p in tmp_path.rglob("part-*"))
    assert kept < most


def test_words_as_text_or_array(spark):
    rows = [(1, "B a \n a"), (2, "a,\u00a0B"), (3, " "), (4, None), (5, "\u00e9-\u0436"), (6, "C!"), (7, "łazienka7 \u0130\u212a a"), (8, "a"), (9, "7AZIENKA\u0144a ik"), (10, "\U0001f6bfa")]
    df = spark.createDataFrame(rows, "id bigint, body string").repartition(3)
    squeezed = text.squeezed(F.col("body"))
    sets = {}
    for r in df.select("id", text.tokens(squeezed).alias("t")).orderBy("id").collect():
        if r.t:
            sets.setdefault(frozenset(r.t), []).append(r.id)
    want = {i: ids[0] for ids in sets.values() for i in ids}
    assert len(want) == 7 and want[2] == 1 and want[10] == 8
    for words in (F.lower(F.col("body")), squeezed, F.split(squeezed, " "), text.tokens(squeezed)):
        got, member = setjoin.encoded_sets(df, "id", words)
        assert {r.id: r.rep for r in member.collect()} == want
        assert {r.rep: r.n for r in got.collect()} == {ids[0]: len(s) for s, ids in sets.items()}


def test_an_index_serves_all_tasks_of_a_block(monkeypatch):
    made = []
    monkeypatch.setattr(setjoin.zlib, "decompress", lambda x, f=zlib.decompress: made.append(1) or f(x))
    sets = [[0, 1, 2, 3], [0, 1, 2, 4], [7, 8]]
    n = np.array([4, 4, 2], np.int32)
    packed = [np.array(s, "<i4").tobytes() for s in sets]
    pdf = pd.DataFrame({"rep": np.arange(3), "n": n, "ids": packed})
    blocks = [types.SimpleNamespace(value=(np.arange(3), n, n, zlib.compress(b"".join(packed)))) for _ in range(2)]
    for block in (blocks[0], blocks[0], blocks[1], blocks[1]):
        got = pd.concat(setjoin._pairs(block, 0.5, True)(iter([pdf])))
        assert list(zip(got.a, got.b)) == [(0, 1)]
    assert len(made) == 2  # each task made its own
