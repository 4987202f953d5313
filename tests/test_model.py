"""The classifier: folds, features, fit."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dispatchline import queries
from dispatchline.functions import text
from dispatchline.operators import model, setjoin

from .conftest import SMALL


def test_five_folds_that_split_no_group_of_near_duplicates(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(10 * g + i, " ".join([*words[9 * g : 9 * g + 9], f"copy{i}"]), "emergency" if g % 2 else "routine") for g in range(40) for i in range(4)]
    rows += [(900, "", "routine"), (901, None, "routine"), (902, "Hi! " + rows[0][1] + " thanks Sue", "routine")]
    df = spark.createDataFrame(rows, "row_id bigint, body string, label string").withColumn("core_hash", text.core_hash(F.col("body")))
    out = model.out_of_fold(df).select("row_id", "fold").toPandas().set_index("row_id").fold
    assert len(out) == len(rows)
    assert set(out) == set(range(5))
    roots = setjoin.near_duplicate_groups(df, "row_id", text.tokens(text.core_text(F.col("body")))).toPandas()
    assert roots.root.nunique() == 40
    assert (roots.assign(fold=out.loc[roots.id].values).groupby("root").fold.nunique() == 1).all()


def test_terms_in_every_text_count_and_single_ones_do_not(spark):
    rows = spark.createDataFrame([(i, f"same {'leak' if i % 2 else 'bill'} only{i}", "emergency" if i % 2 else "routine") for i in range(6)], "row_id bigint, body string, label string")
    fitted = model.fit(rows)
    names = fitted.stages[0].vocabulary
    assert sorted(names) == ["bill", "leak", "same", "same bill", "same leak"]
    v = dict(zip(names, model.with_grams(rows.where("row_id = 1")).transform(fitted.stages[0].transform).transform(fitted.stages[1].transform).transform(fitted.stages[2].transform).first()["_words_v"].toArray()))
    idf = math.log(7 / 4) + 1
    size = math.sqrt(1 + 2 * idf * idf)
    assert (v["same"], v["leak"], v["bill"]) == pytest.approx((1 / size, idf / size, 0))


def test_fit_converges_or_fails(spark):
    rows = spark.createDataFrame([(i, f"{'water leak now' if i % 2 else 'please send the invoice'} {i % 5}", "emergency" if i % 2 else "routine") for i in range(40)], "row_id bigint, body string, label string")
    assert model.fit(rows).stages[-1].summary.totalIterations < model.MAX_ITER
    with pytest.raises(ValueError, match="convergence"):
        model.fit(rows, max_iter=1)


def test_texts_are_solved_in_a_task_and_scored_as_by_the_stages(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("leak", "bill", "boiler", "gas", "no") for b in ("", "s", "ing", "er")] + ["Ünit", "a", "x1"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 12))), rng.choice(text.LABELS)) for i in range(120)] + [(200, None, "routine")]
    df = spark.createDataFrame(rows, "row_id bigint, body string, label string")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    fitted = model.fit(df)
    assert jobs() - before < 12  # a job a step took more than fifty
    y, at = F.array_position(F.array(*[F.lit(x) for x in text.LABELS]), F.col("label")).cast("int") - 1, vector_to_array("probability")
    by_stage = {r.row_id: r for r in fitted.transform(model.with_grams(df)).withColumns({"y": y, "p": at}).collect()}
    for r in model.scored(fitted, df).collect():
        assert r.p_urgent == pytest.approx(1 - by_stage[r.row_id].p[0], abs=1e-9)
        assert r.predicted == text.LABELS[int(by_stage[r.row_id].prediction)]
    # at the minimum, the slope of the loss is the penalty's
    x, p, y = (np.array([v(r) for r in by_stage.values()]) for v in (lambda r: r.features.toArray(), lambda r: r.p, lambda r: r.y))
    weight = len(y) / (3 * np.bincount(y)[y])
    slope = ((p - np.eye(3)[y]) * weight[:, None]).T @ x + fitted.stages[-1].coefficientMatrix.toArray()
    assert abs(slope).max() < 0.02
    assert abs(((p - np.eye(3)[y]) * weight[:, None]).sum(axis=0)).max() < 0.02


def test_folds_are_solved_at_once(spark):
    rows = [(i, f"{'water leak now' if i % 2 else 'please send the invoice'} q{i}a q{i}b q{i}c q{i}d q{i}e q{i}f", "emergency" if i % 2 else "routine") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, body string, label string")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    out = model.out_of_fold(df)
    assert out.where("predicted = label").count() == 40
    assert jobs() - before < 60  # a job a step took more than a hundred


def test_each_pattern_is_looked_for_once(spark):
    plan = queries.QUERIES["cold_model_predictions"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("carbon monoxide") == 1  # it was there for each use of the label


def _words(spark, number, rows):
    """Rows of one word, of a number of words whose grams no other has, one after the other; the word tells the label."""
    i = F.col("row_id") % number
    word = F.concat(*[F.decode(F.unhex(F.hex(c + 0x4E00)), "UTF-16BE") for c in (F.floor(i / 150), i % 150 + 4096)])
    return spark.range(rows).select(F.col("id").alias("row_id")).withColumns({"body": word, "label": F.when(i % 2 == 0, "routine").otherwise("emergency")})


def test_all_rows_are_fitted_however_many(spark):
    fitted = model.fit(_words(spark, 25_500, 51_000))
    assert len(fitted.stages[0].vocabulary) == 25_500  # each word is in two rows, 50,000 rows have fewer such words


def test_each_fold_is_fitted_on_all_rows_of_the_others(spark, monkeypatch):
    monkeypatch.setattr(model, "dealt", lambda rows, folds, text_col: rows.withColumn("fold", F.pmod(F.col("row_id"), F.lit(folds))))
    out = model.out_of_fold(_words(spark, 21_336, 64_008))  # a word's three rows are in three folds, so the other two tell its label
    assert out.where("predicted = label").count() == 64_008
