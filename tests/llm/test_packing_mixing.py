"""Problems 6 and 7: capacities, shares, caps and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from dispatchline.llm import mixing, packing, tokens

PACKS = "pack_name string, capacity_tokens int"


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 140) for _ in range(1500)] + [0, 100, 100, 250, 99]
    d = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    packs = spark.createDataFrame([("p", 100), ("q", 400)], PACKS)
    out = packing.pack(d, packs).collect()
    for name, cap in (("p", 100), ("q", 400)):
        own = [r for r in out if r.pack_name == name]
        per = {}
        for r in own:
            per.setdefault(r.doc_id, []).append(r)
        assert {k: sum(r.n_tokens for r in v) for k, v in per.items()} == dict(enumerate(sizes))
        assert all(len(v) == max(1, -(-sizes[k] // cap)) for k, v in per.items())
        fill = {}
        for r in own:
            if r.container_id:
                fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= cap
        assert [r.doc_id for r in own if r.container_id is None] == [1500]
        assert sum(fill.values()) / (len(fill) * cap) > 0.97
    assert packing.packing_report(packing.pack(d, packs), packs).count() == 2


def test_packing_edges(spark):
    packs = spark.createDataFrame([("p", 10)], PACKS)
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(empty, packs).count() == 0
    ties = spark.createDataFrame([(i, 5, "x") for i in range(40)], "doc_id bigint, n_tokens bigint, shard string")
    assert packing.pack(ties, packs).agg(F.count_distinct("container_id")).first()[0] == 20
    with pytest.raises(Exception, match="at least 1"):
        packing.pack(ties, spark.createDataFrame([("p", 0)], PACKS)).collect()


def test_mix_reaches_its_shares_under_the_caps(spark):
    rng = random.Random(2)
    names = ["a"] * 3000 + ["B-x"] * 200 + ["c"] * 60 + [None] * 5 + ["other"] * 20
    d = spark.createDataFrame([(i, s, max(0, int(rng.lognormvariate(4, 1)))) for i, s in enumerate(names)], "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("a", 0.5, 1), ("b_x", 0.3, 3), ("c", 0.15, 4), ("none_there", 0.05, 2)], "source string, target_share double, max_repeats int")
    out = mixing.mix(d, t)
    report = {r.source: r for r in mixing.mix_report(out, t).collect()}
    for s, share, cap in (("a", 0.5, 1), ("b_x", 0.3, 3), ("c", 0.15, 4)):
        assert report[s].actual_share == pytest.approx(share / 0.95, rel=0.003)
        assert report[s].most_copies <= cap
    assert report["none_there"].actual_share == 0
    assert max(r.most_copies for r in report.values()) > 1
    assert {r.source for r in out.where("n_copies > 0").collect()} == {"a", "b_x", "c"}
    small = mixing.mix(d, t, total_tokens=5000)
    assert small.agg(F.sum(F.col("n_tokens") * F.col("n_copies"))).first()[0] == pytest.approx(5000, rel=0.02)


def test_mix_edges(spark):
    d, t = "doc_id bigint, source string, n_tokens bigint", "source string, target_share double, max_repeats int"
    targets = spark.createDataFrame([("a", 1.0, 2), ("z", None, 1), (None, 0.5, 1)], t)
    assert mixing.mix(spark.createDataFrame([], d), targets).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a", 5)], d), targets.where("source = 'q'")).count() == 0
    same = mixing.mix(spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 0)], d), targets).collect()
    assert sorted((r.doc_id, r.n_copies) for r in same) == [(1, 2), (2, 2)]


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "Hello there, the boiler leaks."), (2, ""), (3, None), (4, "шаг 🙏")], "doc_id bigint, text string")
    enc = tokens.encoder()
    got = {r.doc_id: r.n_tokens for r in tokens.with_tokens(d).collect()}
    assert got == {1: len(enc.encode_ordinary("Hello there, the boiler leaks.")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("шаг 🙏"))}
    assert enc.decode(enc.encode_ordinary("шаг 🙏")) == "шаг 🙏"
