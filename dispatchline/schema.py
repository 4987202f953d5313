"""Tables with their types and the conditions that their rows must meet; rows that don't are set apart, not lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import LABELS

MESSAGES = "row_id bigint, message_id string, received_at string, feed_id int, channel string, from_name string, body string, body_hash string, created_at timestamp"
CLASSIFICATIONS = "body_hash string, urgency string, intent string, score int, reason string, rule_hits string, llm_urgency string, model string, prompt_version string, created_at timestamp"
CORPUS = "id bigint, message_id string, body string, body_hash string, urgency string, dup_group bigint, source string, created_at timestamp"
COMBINED = "row_id bigint, message_id string, core_hash string, label string, label_source string, confidence double, source string, split_name string"
PREDICTIONS = "message_id string, urgency string, score int, reason string, source string"

_IN_LABELS = "({} IN (" + ", ".join(f"'{x}'" for x in LABELS) + "))"
#: name of a condition -> SQL that holds for a good row, for each table.
CHECKS = {
    "messages": {"no_message_id": "message_id IS NOT NULL", "no_received_at": "received_at IS NOT NULL", "no_channel": "channel IS NOT NULL", "no_body": "body IS NOT NULL"},
    "classifications": {"no_body_hash": "body_hash IS NOT NULL", "bad_urgency": _IN_LABELS.format("urgency"), "bad_score": "score BETWEEN 0 AND 100"},
    "corpus": {"no_body": "body IS NOT NULL", "bad_urgency": _IN_LABELS.format("urgency"), "bad_source": "source IN ('seed', 'override')"},
}


def checked(rows: DataFrame, table: str) -> DataFrame:
    """The rows with ``broken``: the names of the conditions they don't meet (a condition on null isn't met)."""
    broken = [F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in CHECKS[table].items()]
    return rows.withColumn("broken", F.array_compact(F.array(*broken)))


def good(rows: DataFrame, table: str) -> DataFrame:
    return checked(rows, table).where(F.size("broken") == 0).drop("broken")


def quarantined(rows: DataFrame, table: str) -> DataFrame:
    return checked(rows, table).where(F.size("broken") > 0)
