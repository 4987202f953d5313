"""Text, rules, store, joins, votes and metrics on small cases with known results."""

import re

import pytest
from pyspark.sql import functions as F

from dispatchline.functions import text
from dispatchline.operators import metrics, retrieval, rules, setjoin, store
from dispatchline.plans import classify
from dispatchline.sources import files


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "body string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "core"),
    [("new boiler installation", "new boiler ins"), ("whats the best boiler", "whats the"), ("hiya, quota?", "quota"), ("call 07700 900123 ta", "call"), ("need the data now", "need the da"), ("Hi Hi. thanks Sue!", "hi"), ("", ""), (None, None)],
)
def test_core_text(spark, raw, core):
    assert one(spark, text.core_text(F.col("body")), raw) == core


def test_strict_sign_off(spark):
    assert one(spark, text.core_text(F.col("body"), strict=True), "new boiler installation") == "new boiler installation"


def char_wb(t, low=3, high=5):
    """The documented algorithm: per word padded with blanks; a short word counts once."""
    out = []
    for w in re.sub(r"\s+", " ", t.lower()).split():
        w = f" {w} "
        for n in range(low, high + 1):
            at = 0
            out.append(w[at : at + n])
            while at + n < len(w):
                at += 1
                out.append(w[at : at + n])
            if at == 0:
                break
    return sorted(out)


@pytest.mark.parametrize("raw", ["a bc def ghij", "x", "", "Łódź w  maju", "no heating\tat all"])
def test_char_grams(spark, raw):
    assert sorted(one(spark, text.char_grams(F.col("body")), raw)) == char_wb(raw)


@pytest.mark.parametrize(
    ("body", "hits", "floor"),
    [
        ("there is a smell of gas in the hall", ["gas_smell"], "emergency"), ("Strong SMEEELL, gasss!", ["gas_smell"], "emergency"), ("the CO alarm went off", ["carbon_monoxide"], "emergency"), ("water pouring through the light", ["flood_burst"], "emergency"),
        ("burning smell from the socket", ["fire_electric"], "emergency"), ("a 20 year old boiler quote", ["vulnerable_occupant"], "same_day"), ("floodlight is broken", ["flood_burst"], "emergency"), ("no heating and a newborn here", ["vulnerable_occupant", "vulnerable_no_service"], "emergency"),
        ("invoice for the gas meter please", [], "routine"), (None, [], "routine"), ("", [], "routine"),
    ],
)
def test_rules(spark, body, hits, floor):
    h = rules.hits(F.col("body"))
    assert one(spark, h, body) == hits
    assert one(spark, rules.floor_label(h, F.lit("routine")), body) == floor
    assert one(spark, rules.floor_label(h, F.lit("emergency")), body) == "emergency"
    assert one(spark, rules.floor_label(h, F.lit("who knows")), body) is None


def test_scores(spark):
    df = spark.createDataFrame([(120, "routine", "emergency"), (-3, "routine", "routine"), (90, "same_day", "same_day")], "s int, a string, b string")
    assert [r[0] for r in df.select(rules.score_if_raised(F.col("s"), F.col("a"), F.col("b"))).collect()] == [100, 0, 90]
    assert spark.range(1).select(rules.score_of_probability(F.lit(0.875), F.lit("routine")), rules.score_of_probability(F.lit(0.995), F.lit("same_day"))).first()[:] == (12, 40)


@pytest.mark.parametrize(
    ("k", "n", "low", "high"), [(0, 6, 0.0, 0.390343), (0, 22, 0.0, 0.148660), (2, 6, 0.096769, 0.700012), (9, 22, 0.232556, 0.612655), (16, 22, 0.518479, 0.868494), (10, 11, 0.622635, 0.983768), (11, 11, 0.741160, 1.0), (0, 0, 0.0, 1.0)]
)
def test_wilson(spark, k, n, low, high):
    r = spark.range(1).select(*metrics.wilson(F.lit(k), F.lit(n))).first()
    assert r[0] == pytest.approx(low, abs=1e-6)
    assert r[1] == pytest.approx(high, abs=1e-6)


def test_store(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "w")], "n int, k string, v string")
    assert sorted(r[:] for r in store.keep_first(rows, "k", "n").collect() if r.k) == [(1, "a", "x")]
    assert store.keep_first(rows, "k", "n").count() == 3
    there = spark.createDataFrame([(0, "a", "old")], "n int, k string, v string")
    assert [r.v for r in store.insert_if_absent(there, rows, "k", "n").collect()] == ["old"]
    assert [r[:] for r in store.upsert_labels(rows, "k", "n", ("v",)).collect()] == [(1, "a", "y")]
    assert store.next_group(rows.select(F.col("n").alias("dup_group")).where("n > 9")).first()[0] == 0
    assert sorted(r.dup_group for r in store.number_new_groups(spark.range(5).withColumnRenamed("id", "i"), spark.range(3).select(F.col("id").alias("dup_group")), "i").collect()) == [3, 4, 5, 6, 7]


def test_similar_sets_against_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 14))] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join(w[:-1] + ["extra"])) for i, w in enumerate(base[:30])] + [(200, ""), (201, None), (202, " ".join(base[0])), (203, " ".join(f"v{i}" for i in range(300))), (204, " ".join(f"v{i}" for i in range(30, 310)))]
    df = spark.createDataFrame(rows, "id bigint, body string")
    sets = {i: frozenset(t.split()) for i, t in rows if t}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > 0.6 * len(sets[a] | sets[b])}
    parent = {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in want:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = setjoin.near_duplicate_groups(df, "id", text.tokens(text.squeezed(F.col("body"))))
    assert {r.id: r.root for r in got.collect()} == {i: root(i) for i in sets}
    empty = df.where("id < 0")
    assert setjoin.near_duplicate_groups(empty, "id", text.tokens(text.squeezed(F.col("body")))).count() == 0


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200).select(F.col("id").alias("node"))
    edges = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a != 99")
    roots = {r.root for r in setjoin.components(nodes, edges).collect()}
    assert roots == {0, 100}


def test_hot_keys_join_alike(spark, monkeypatch):
    from dispatchline import session

    rows = session.checkpointed(spark.range(4000).selectExpr("id", "if(id % 3 = 0, -1, id % 500) AS k"))
    table = session.checkpointed(spark.range(-1, 400).selectExpr("id AS k", "id * 2 AS v"))
    want = sorted(r[:] for r in session.join_hot(rows, table, "k").select("id", "k", "v").collect())
    monkeypatch.setattr(session, "HOT_ROWS", 100)
    assert sorted(r[:] for r in session.join_hot(rows, table, "k").select("id", "k", "v").collect()) == want
    nodes, edges = spark.range(600).selectExpr("id AS node"), spark.range(1, 500).selectExpr("0L AS a", "id AS b")
    assert {(r.root, r["count"]) for r in setjoin.components(nodes, edges).groupBy("root").count().collect()} == {(0, 500)} | {(i, 1) for i in range(500, 600)}


def test_vote_ties_and_abstention(spark):
    n = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.45), (1, 2, 0.45), (2, 1, 0.2)], "query_id int, label int, sim double")
    assert {r.query_id: (r.label, r.confidence) for r in retrieval.vote(n, 0.6).collect()} == {1: (2, 0.5), 2: (None, None)}


def test_alert_threshold_without_scores_and_without_room(spark):
    scores = spark.createDataFrame([(0.2,), (0.9,)] * 9 + [(None,)], "p double")
    assert metrics.alert_threshold(scores).first().threshold == pytest.approx(0.905)
    assert metrics.alert_threshold(scores.where("p > 2")).first().threshold is None
    assert metrics.alert_threshold(scores.where("p = 0.9").select(F.lit(1.0).alias("p"))).first().threshold is None


def test_classifier_is_asked_once_a_hash_and_bad_answers_are_set_apart(spark):
    m = spark.createDataFrame([(1, "a", "Hello there", None, "sms"), (2, "b", "hello, there!", None, None), (3, "b", "other", None, None), (4, "c", None, None, None), (5, "d", "gas leak", None, None)], "row_id bigint, message_id string, body string, created_at timestamp, channel string")
    k = spark.createDataFrame([], "body_hash string, urgency string, llm_urgency string, score int, reason string")
    out = {r.row_id: r for r in classify.classify(m, k).collect()}
    assert sorted(out) == [1, 2, 4, 5]
    assert (out[5].urgency, out[5].intent, out[5].rule_hits, out[4].urgency, out[4].from_cache) == ("emergency", '["other"]', '["gas_smell"]', None, None)
    assert classify.to_store(classify.classify(m, k)).count() == 2

    def stubborn(asked):
        assert all("Message to classify" in p for p in asked["prompt"])
        return [("maybe" if "gas" in b else "routine", ["other"], 140, "x") for b in asked["body"]]

    bad = classify.classify(m, k, stubborn, pause_s=0.0)
    assert {r.row_id: r.reason for r in classify.quarantined(bad).collect()} == {5: "refused: unknown label 'maybe'"}
    assert {r.score for r in classify.to_store(bad).collect()} == {100}

    def broken(asked):
        raise OSError("away")

    assert {r.reason for r in classify.quarantined(classify.classify(m, k, broken, pause_s=0.0)).collect()} == {"no answer: away"}


def test_cache_key_of_model_and_prompt_version(spark):
    m = spark.createDataFrame([(1, "a", "x")], "row_id bigint, message_id string, body string")
    k = m.select(text.body_hash(F.col("body")).alias("body_hash"), F.lit("same_day").alias("llm_urgency"), F.lit(None).cast("string").alias("urgency"), F.lit(45).alias("score"), F.lit("r").alias("reason"), F.lit("a").alias("model"), F.lit("v1").alias("prompt_version"))
    assert classify.classify(m, k).first().from_cache
    assert classify.classify(m, k, model="a", prompt_version="v1").first().urgency == "same_day"
    other = classify.classify(m, k, model="a", prompt_version="v2").first()
    assert (other.from_cache, other.prompt_version) == (False, "v2")


def test_corrections(spark):
    m = spark.createDataFrame([(1, "a", "Leak!"), (2, "b", "bill"), (3, "a", "other"), (4, "n", None)], "row_id bigint, message_id string, body string")
    pool = m.where("row_id = 2").select(text.body_hash(F.col("body")).alias("body_hash"), F.lit("old").alias("message_id"), "body", F.lit("routine").alias("urgency"), F.lit(7).cast("bigint").alias("dup_group"), F.lit("seed").alias("source"))
    asked = spark.createDataFrame([(1, "b", "same_day"), (2, "a", "same_day"), (3, "a", "emergency"), (4, "zz", "routine"), (5, "n", "routine")], "seq bigint, message_id string, urgency string")
    after, unknown = store.add_labels(pool, m, asked)
    assert sorted((r.message_id, r.urgency, r.dup_group, r.source) for r in after.collect()) == [("a", "emergency", 8, "override"), ("old", "same_day", 7, "override")]
    assert [r.message_id for r in unknown.collect()] == ["zz"]


def test_files(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('message_id,received_at,channel,from_name,body,urgency\nm1,6/8/2026 9:05:00,sms,A,"two\nlines, ""quoted""",routine\n')
    r = files.messages_csv(spark, str(p)).first()
    assert (r.received_at, r.body, r.gold_label, r.source) == ("2026-08-06T09:05:00", 'two\nlines, "quoted"', "routine", "messages")
    out = str(tmp_path / "predictions")
    files.write_predictions(spark.createDataFrame([("m1", "hot")], "message_id string, source string"), out)
    with pytest.raises(FileExistsError):
        files.write_predictions(spark.createDataFrame([("m2", "cold")], "message_id string, source string"), out)
    files.write_predictions(spark.createDataFrame([("m2", "cold")], "message_id string, source string"), out, force=True)
    assert spark.read.parquet(out).count() == 1


def test_model_artifacts_and_stream(spark, tmp_path):
    from dispatchline.operators import model
    from dispatchline.streaming import ingest

    rows = spark.createDataFrame([(i, f"{'water leak now' if i % 2 else 'please send the invoice'} {i % 5}", "emergency" if i % 2 else "routine", f"g{i // 2}") for i in range(40)], "row_id bigint, body string, label string, core_hash string")
    fitted = model.fit(rows)
    assert model.save(fitted, str(tmp_path / "a"), {"threshold": 0.5}) == 1
    assert model.save(fitted, str(tmp_path / "a"), {"threshold": 0.6}) == 2
    again, config = model.load(str(tmp_path / "a"))
    assert (config["version"], config["threshold"]) == (2, 0.6)
    assert model.scored(again, rows).where("predicted = label").count() == 40
    m = spark.createDataFrame([(1, "a", "burst pipe", None), (2, "a", "again", None), (3, "b", None, None)], "row_id bigint, message_id string, body string, created_at timestamp").withColumn("created_at", F.lit("2025-01-01").cast("timestamp"))
    m.coalesce(1).write.parquet(str(tmp_path / "in"))
    k = spark.createDataFrame([], "body_hash string, llm_urgency string")
    for _ in range(2):
        ingest.run_once(ingest.ingest(ingest.arriving(spark, str(tmp_path / "in")), k), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.message_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_lookup_quarantine_and_share(spark):
    from dispatchline import schema

    rows = spark.createDataFrame([("h", "routine", 5), ("g", "maybe", 500), (None, None, None)], "body_hash string, urgency string, score int")
    assert store.lookup(rows, "body_hash", "h").count() == 1
    assert store.lookup(rows, "body_hash", None).count() == 0
    assert schema.good(rows, "classifications").count() == 1
    assert sorted(r.broken for r in schema.quarantined(rows, "classifications").collect()) == [["bad_urgency", "bad_score"], ["no_body_hash", "bad_urgency", "bad_score"]]
    assert spark.range(1).select(metrics.share_text(F.lit(9), F.lit(22)), metrics.share_text(F.lit(0), F.lit(0))).first()[:] == ("9/22=41% (CI 23-61)", "0/0")


def test_retrain(spark, tmp_path):
    from dispatchline.plans.retrain import retrain

    rows = spark.createDataFrame([(i, f"h{i % 30}", f"{'water leak now' if i % 3 == 0 else 'please send the invoice'} {i % 5}", "Emergency" if i % 3 == 0 else "routine") for i in range(60)] + [(90, None, "x", None)], "row_id bigint, core_hash string, body string, label string")
    config = retrain(rows, str(tmp_path / "m"), folds=2)
    assert (config["version"], config["train_rows"], config["class_counts"]["emergency"]) == (1, 30, 10)
