"""Messages without a body."""

from dispatchline import queries


def test_messages_without_a_body_come_out(spark, tmp_path):
    spark.createDataFrame([(1, "a", "gas leak", None), (2, "b", None, None)], "row_id bigint, message_id string, body string, created_at timestamp").write.parquet(str(tmp_path / "messages.parquet"))
    spark.createDataFrame([], "body_hash string, urgency string, llm_urgency string, score int, reason string").write.parquet(str(tmp_path / "classifications.parquet"))
    got = {r.row_id: r for r in queries.QUERIES["classified_end_to_end"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2]
    assert (got[1].urgency, got[2].urgency, got[2].score, got[2].rule_hits) == ("emergency", None, None, "[]")
    assert sorted(r.row_id for r in queries.QUERIES["inbox_all_messages"](spark, str(tmp_path)).collect()) == [1, 2]
