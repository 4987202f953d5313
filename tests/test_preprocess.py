"""Grouped halves, the preparation plan, sources and reports."""

import pytest
from pyspark.sql import functions as F

from dispatchline.functions import text
from dispatchline.operators import grouped, metrics, rules
from dispatchline.plans import preprocess
from dispatchline.sources import files

WORDS = [f"w{i}" for i in range(400)]


def rows_of_groups(n_groups, copies):
    return [(10 * g + i, " ".join([*WORDS[9 * g : 9 * g + 9], f"copy{i}"]), ("routine", "routine", "same_day", "emergency")[g % 4]) for g in range(n_groups) for i in range(copies)]


def test_halves_keep_groups_and_shares(spark):
    rows = rows_of_groups(40, 3) + [(900, "", "routine"), (901, None, "routine"), (902, "x", "unknown")]
    df = spark.createDataFrame(rows, "row_id bigint, body string, label string")
    out = grouped.disjoint(grouped.halves(df, text.tokens(text.core_text(F.col("body"))))).toPandas()
    assert sorted(out.id) == sorted(r[0] for r in rows if r[2] != "unknown")
    assert (out.groupby("root").fold.nunique() == 1).all()
    label = {r[0]: r[2] for r in rows}
    per = out.assign(label=out.id.map(label)).groupby(["label", "fold"]).id.count()
    assert all(abs(per[x, 0] - per[x, 1]) <= 5 for x in ("routine", "same_day", "emergency"))
    assert grouped.halves(df.where("row_id < 0"), text.tokens(F.col("body"))).count() == 0
    torn = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "root int, fold int")
    with pytest.raises(ValueError, match="1 groups"):
        grouped.disjoint(torn)


def test_preparation(spark, tmp_path):
    rows = [(i, f"m{i}", "2026-01-01", "sms", "A", b, x, "messages") for i, b, x in rows_of_groups(40, 2)]
    rows += [(1000 + i, f"u{i}", None, None, None, b + " again", None, s) for i, (b, s) in enumerate([(rows[0][5], "messages"), (rows[2][5], "messages"), (rows[0][5], "holdout"), (rows[2][5], "holdout"), ("nothing alike", "messages"), ("", "messages")])]
    df = spark.createDataFrame(rows, "row_id bigint, message_id string, received_at string, channel string, from_name string, body string, gold_label string, source string")
    out = preprocess.preprocess(df, F.lit(True))
    assert out.columns == preprocess.COLUMNS
    preprocess.write(out, str(tmp_path))
    combined = {r.row_id: r for r in spark.read.parquet(str(tmp_path / "combined")).collect()}
    assert len(combined) == len(rows)
    for i, g in ((1000, 0), (1001, 10), (1002, 0), (1003, 10)):  # a copy of a group in the training half is found, one of the other half isn't
        assert combined[i].label_source == ("synthetic" if combined[g].label_source == "gold_train" else "none")
    assert combined[1004].label is None and combined[1005].label is None
    train = {r.row_id for r in spark.read.parquet(str(tmp_path / "train")).collect()}
    assert train == {i for i, r in combined.items() if r.source == "messages" and r.label_source in ("gold_train", "synthetic")}


def test_sources(spark, tmp_path):
    (tmp_path / "a_messages.csv").write_text("x")
    assert files.only(spark, str(tmp_path / "*messages*.csv")).endswith("a_messages.csv")
    with pytest.raises(FileNotFoundError, match="0 files"):
        files.only(spark, str(tmp_path / "*holdout*.csv"))
    (tmp_path / "t.csv").write_text("trap_id,trap_kind,expected,received_at,channel,from_name,body\nt1,decoy,routine,2026-01-01T10:00:00,sms,A,no rush\n")
    assert files.traps_csv(spark, str(tmp_path / "t.csv")).first().expected == "routine"
    ids = spark.createDataFrame([("m", "b"), (None, "b"), (None, "b"), (None, None)], "i string, b string").select(text.with_id(F.col("i"), F.col("b")).alias("i")).collect()
    assert ids[0].i == "m" and ids[1].i == ids[2].i != ids[3].i and len(ids[1].i) == 12


# Sentences of our own, one for each kind of trap: kind, expected label, label by the rules, rules hit, text.
TRAPS = [
    ("deescalation_vs_gas", "emergency", "emergency", ["gas_smell"], "Sorry to bother, probably nothing, but the kitchen smells of gas a bit"),
    ("deescalation_decoy", "routine", "routine", [], "No panic at all, just wondering when my service is due"),
    ("buried_in_compliment", "emergency", "emergency", ["flood_burst"], "Lovely work last week! By the way a burst pipe is soaking the hall"),
    ("buried_in_compliment", "emergency", "emergency", ["carbon_monoxide"], "Great team. The CO detector keeps going off though"),
    ("inaudible_truncation", "emergency", "emergency", ["gas_smell"], "hello [inaudible] smell of gas in the [inaudible]"),
    ("inaudible_truncation", "same_day", "routine", [], "boiler [inaudible] since this morning [inaudible] cold"),
    ("typos", "emergency", "emergency", ["gas_smell"], "ther is a smel of gass in the porch"),
    ("allcaps", "emergency", "emergency", ["flood_burst"], "WATER IS COMING THROUGH THE CEILING"),
    ("allcaps_decoy", "routine", "routine", [], "PLEASE SEND ME THE INVOICE"),
    ("vulnerable_no_keyword", "emergency", "emergency", ["vulnerable_occupant", "vulnerable_no_service"], "My gran is 84 and there is no hot water here"),
    ("vulnerable_no_keyword", "same_day", "emergency", ["vulnerable_occupant", "vulnerable_no_service"], "Toddler at home, heating is off in one room"),
    ("gas_wrong_sense", "routine", "routine", [], "Can you quote to service a gas fire"),
    ("past_tense_resolved", "routine", "emergency", ["gas_smell"], "The gas leak you mended in May is still fine, thanks"),
    ("electric", "emergency", "emergency", ["fire_electric"], "There is a burning smell from the socket"),
    ("old_boiler", "routine", "same_day", ["vulnerable_occupant"], "A price for a 20 year old boiler please"),
    ("floodlight", "routine", "emergency", ["flood_burst"], "The floodlight over the drive is broken"),
]


def test_traps(spark):
    df = spark.createDataFrame([(f"t{i}", k, e, b) for i, (k, e, _, _, b) in enumerate(TRAPS)], "trap_id string, trap_kind string, expected string, body string")
    hit = df.withColumn("hits", rules.hits(F.col("body"))).withColumn("predicted", rules.floor_label(F.col("hits"), F.lit("routine")))
    got = {r.trap_id: r for r in hit.collect()}
    assert [(got[f"t{i}"].predicted, got[f"t{i}"].hits) for i in range(len(TRAPS))] == [(f, h) for _, _, f, h, _ in TRAPS]
    long = hit.withColumn("channel", F.lit("rules")).unionByName(hit.withColumn("channel", F.lit("always")).withColumn("predicted", F.lit("routine")))
    counts = {r.channel: (r.n, r.exact, r.under, r.over) for r in metrics.trap_counts(long).collect()}
    assert counts["rules"] == (16, 11, 1, 4)
    report = {r.trap_id: r for r in metrics.trap_report(long).collect()}
    assert report["t5"].missed and report["t5"].predicted == {"rules": "routine", "always": "routine"} and report["t5"].body == TRAPS[5][4]
    assert not report["t1"].missed and report["t1"].body is None


def test_words_of_halves_are_made_once(spark):
    rows = rows_of_groups(20, 2)
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(body):
        made.add(1)
        return body.split()

    df = spark.createDataFrame(rows, "row_id bigint, body string, label string")
    assert grouped.halves(df, words("body")).count() == len(rows)
    assert made.value == len(rows)  # they were made again for each pass over the words
