"""Registry of the llm queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, read
from . import copies, mixing, overlaps, packing, pii, sentences, splits
from .tokens import with_tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


SETS_SQL = """
WITH RECURSIVE tied AS (
  SELECT DISTINCT a.id AS id, b.id AS other FROM corpus a JOIN corpus b ON a.dup_group = b.dup_group
  UNION SELECT DISTINCT a.id, b.id FROM corpus a JOIN corpus b ON a.message_id = b.message_id
), reach AS (
  SELECT id, id AS other FROM corpus
  UNION SELECT r.id, t.other FROM reach r JOIN tied t ON r.other = t.id
)
SELECT min(other) AS id_a, id AS id_b FROM reach GROUP BY id HAVING min(other) < id
"""


@query("p2_found", SETS_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id_a, id_b: each corpus row that isn't the smallest of its set, with that smallest."""
    return splits.connected(read(spark, sf_dir, "corpus")).where("id != root").select(F.col("root").alias("id_a"), F.col("id").alias("id_b"))


@query("p2_assignment")
def p2_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every corpus row."""
    return splits.assign_splits(read(spark, sf_dir, "corpus"), read(spark, sf_dir, "split_targets"))


@query("p2_report")
def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and shares of each split and label."""
    targets = read(spark, sf_dir, "split_targets")
    return splits.split_report(splits.assign_splits(read(spark, sf_dir, "corpus"), targets), targets)


OVERLAP_SQL = r"""
WITH r AS (
  SELECT c.row_id AS id, c.message_id, lower(trim(c.split_name)) AS split_name,
    coalesce(regexp_replace(lower(trim(c.source)), '[\s\-]+', '_', 'g'), 'unknown') AS source,
    list_distinct(regexp_extract_all(lower(m.body), '[\p{L}\p{N}]+')) AS w
  FROM combined c LEFT JOIN messages m USING (row_id) WHERE lower(trim(c.split_name)) IN ('train', 'valid', 'test')
), e AS (SELECT * FROM r WHERE split_name <> 'train'), t AS (SELECT * FROM r WHERE split_name = 'train'),
p AS (
  SELECT e.id AS ie, t.id AS it FROM e, t WHERE len(e.w) > 0 AND len(t.w) > 0
    AND len(list_intersect(e.w, t.w)) * 1.8 >= 0.8 * (len(e.w) + len(t.w)) - 1e-9
  UNION
  SELECT e.id, t.id FROM e JOIN corpus x ON e.message_id = x.message_id JOIN corpus y ON x.dup_group = y.dup_group
    JOIN t ON t.message_id = y.message_id
)
"""


@query("p4_found", OVERLAP_SQL + "SELECT least(ie, it) AS row_id_a, greatest(ie, it) AS row_id_b FROM p")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id_a, row_id_b: a train row and a row of valid or test that overlap, the smaller id first."""
    p = overlaps.cross_split_overlaps(*(read(spark, sf_dir, t) for t in ("combined", "messages", "corpus")))
    return p.select(F.least("id_eval", "id_train").alias("row_id_a"), F.greatest("id_eval", "id_train").alias("row_id_b"))


@query(
    "p4_report",
    OVERLAP_SQL
    + """, h AS (SELECT ie AS id, count(*) AS k FROM p GROUP BY ie)
SELECT split_name, source, count(*) AS n_rows, count(k) AS n_leaked, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_pairs
FROM e LEFT JOIN h USING (id) GROUP BY ALL""",
)
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps counted per split and source."""
    return overlaps.overlap_report(*(read(spark, sf_dir, t) for t in ("combined", "messages", "corpus")))


CANON_SQL = r"""
WITH m AS (
  SELECT row_id, body, regexp_replace(body, '[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g') AS b FROM messages WHERE body IS NOT NULL
), s AS (
  SELECT row_id, body, string_split(regexp_replace(b, '(^|[\n\r;|])[^\p{L}\p{N}\n\r;|]*(\p{L}+([ \x{a0}]\p{L}+){0,2}[\t\f\v \p{Z}]*:)', chr(1) || '\2', 'g'), chr(1)) AS f FROM m
), k AS (
  SELECT row_id, CASE WHEN len(f) >= 3 AND NOT regexp_matches(f[1], '[\p{L}\p{N}]')
    THEN list_aggregate(list_sort(list_transform(f[2:], lambda x: lower(upper(regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g'))))), 'string_agg', chr(2))
    ELSE lower(upper(regexp_replace(body, '[^\p{L}\p{N}]+', '', 'g'))) END AS key FROM s
), g AS (SELECT row_id, min(row_id) OVER (PARTITION BY key) AS rep, count(*) OVER (PARTITION BY key) AS n FROM k WHERE key <> '')
"""


@query("p5_found", CANON_SQL + "SELECT rep AS row_id_a, row_id AS row_id_b FROM g WHERE rep <> row_id")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id_a, row_id_b: each message that isn't the first of its copies, with that first."""
    return copies.copies(read(spark, sf_dir, "messages")).where("row_id != rep").select(F.col("rep").alias("row_id_a"), F.col("row_id").alias("row_id_b"))


@query("p5_collapsed", CANON_SQL + "SELECT row_id, n AS n_copies, sha256(body) AS text_hash FROM g JOIN messages USING (row_id) WHERE row_id = rep")
def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each group of copies, with its number of copies."""
    return copies.collapsed(read(spark, sf_dir, "messages")).select("row_id", "n_copies", F.sha2("text", 256).alias("text_hash"))


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct stretch of personal data of each message."""
    return pii.find(read(spark, sf_dir, "messages"), read(spark, sf_dir, "contacts"))


@query("p3_redacted")
def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages with typed placeholders in place of personal data."""
    return pii.redact(read(spark, sf_dir, "messages"), read(spark, sf_dir, "contacts"))


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_char of each sentence."""
    return sentences.sentences(read(spark, sf_dir, "documents"), with_text=False).select("doc_id", "start_char")


@query("p8_sentences")
def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document in order."""
    return sentences.sentences(read(spark, sf_dir, "documents"))


@query("p6_packing")
def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or of each piece of one that exceeds the capacity."""
    return packing.pack(checkpointed(with_tokens(read(spark, sf_dir, "documents"))), read(spark, sf_dir, "pack_sizes"))


@query("p6_report")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each capacity are filled."""
    return packing.packing_report(p6_packing(spark, sf_dir), read(spark, sf_dir, "pack_sizes"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = with_tokens(read(spark, sf_dir, "documents"), "doc_id bigint, source string")
    return mixing.mix(counted, read(spark, sf_dir, "mix_targets"))


@query("p7_mix")
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their numbers of copies."""
    return _mixed(spark, sf_dir).where("n_copies > 0").select("doc_id", "source", "n_tokens", "n_copies")


@query("p7_report")
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached, beside their targets."""
    return mixing.mix_report(_mixed(spark, sf_dir), read(spark, sf_dir, "mix_targets"))
