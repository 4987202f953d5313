"""The alert budget counts messages, not texts."""

from pyspark.sql import functions as F

from dispatchline import queries
from dispatchline.functions import text
from dispatchline.operators import metrics, model
from dispatchline.plans.retrain import retrain


def test_a_text_of_many_messages_counts_as_often(spark, tmp_path):
    m = spark.createDataFrame([(i, "Gas leak!" if i < 30 else f"bill {i}") for i in range(90)] + [(99, None), (98, "no answer")], "row_id bigint, body string")
    m.write.parquet(str(tmp_path / "messages.parquet"))
    k = m.where("body IS NOT NULL AND row_id < 90").groupBy(text.body_hash(F.col("body")).alias("body_hash")).agg(F.max(F.when(F.col("body") == "Gas leak!", 90).otherwise(10)).alias("score"))
    k.write.parquet(str(tmp_path / "classifications.parquet"))
    at = {r.threshold: r.alerts_per_day for r in queries.QUERIES["flags_per_day_grid_messages"](spark, str(tmp_path)).collect()}
    assert (at[0.05], at[0.5], at[0.95]) == (90, 30, 0)
    assert queries.QUERIES["alert_threshold_messages"](spark, str(tmp_path)).first().threshold == 0.905


def test_retrain_takes_the_threshold_on_all_messages(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"h{i}", f"{'water leak now' if i % 3 == 0 else 'please send the invoice'} {i % 5}", "emergency" if i % 3 == 0 else "routine") for i in range(30)], "row_id bigint, core_hash string, body string, label string")
    messages = spark.createDataFrame([("water leak now 0",)] * 40 + [("please send the invoice 1",)] * 20, "body string")
    seen, grid = [], metrics.alert_threshold
    monkeypatch.setattr(model, "out_of_fold", lambda train, folds: train.withColumn("p_urgent", F.lit(0.5)))
    monkeypatch.setattr(metrics, "alert_threshold", lambda scores, *a, **k: seen.append(sorted(r.n for r in scores.collect())) or grid(scores, *a, **k))
    retrain(rows, str(tmp_path / "m"), messages=messages)
    assert seen == [[20, 40]]
