"""Streaming ingest over several micro-batches."""

import os

from dispatchline.streaming import ingest


def test_late_messages_and_late_repeats_over_several_batches(spark, tmp_path):
    files = [[(5, "new", "2026-08-01")], [(4, "ahead", "2031-01-01")], [(1, "old", "2025-01-01"), (2, "older", "2020-01-01")], [(6, "new", "2026-12-01"), (7, "old", "2025-06-01"), (8, None, "2025-01-01"), (9, None, "2025-01-01")]]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(files):
        df = spark.createDataFrame([(n, m, f"text {n}", t) for n, m, t in rows], "row_id bigint, message_id string, body string, created_at string").selectExpr("row_id", "message_id", "body", "cast(created_at as timestamp) AS created_at")
        df.coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        part = next((tmp_path / f"w{i}").glob("*.parquet"))
        part.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    k = spark.createDataFrame([], "body_hash string, llm_urgency string")
    for checkpoint in ("a", "a", "b"):
        ingest.run_once(ingest.ingest(ingest.arriving(spark, str(tmp_path / "in"), 1), k), str(tmp_path / "out"), str(tmp_path / checkpoint))
        if checkpoint == "a":
            assert sorted(r.row_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4, 5, 8, 9]
    named = spark.read.parquet(str(tmp_path / "out")).where("message_id IS NOT NULL")
    assert sorted(r.message_id for r in named.collect()) == ["ahead", "new", "old", "older"]
