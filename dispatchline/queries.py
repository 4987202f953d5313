"""Registry of the core queries: name -> callable(spark, sf_dir), and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .functions import text
from .operators import grouped, metrics, model, retrieval, rules, setjoin, store, timestamps
from .plans import classify, preprocess, retrain
from .session import checkpointed, fenced, read, scratch, spread
from .sources import files
from .streaming import ingest

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


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, utc_us of each message whose received_at denotes exactly one instant."""
    out = timestamps.normalise_timestamps(read(spark, sf_dir, "messages"), read(spark, sf_dir, "feeds"))
    return out.where("status = 'resolved'").select("row_id", "utc_us")


@query("p1_status")
def p1_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each feed and format were resolved, or why not."""
    out = timestamps.normalise_timestamps(read(spark, sf_dir, "messages"), read(spark, sf_dir, "feeds"))
    return out.groupBy("feed_id", "kind", "status").agg(F.count("*").alias("n"))


# --- SQL pieces -------------------------------------------------------------------------------------------------------

LABEL_LIST = "['routine', 'same_day', 'emergency']"


def _sq(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _cold(x: str) -> str:
    word = r"[\p{L}\p{M}\p{N}_]"
    phone = rf"regexp_replace(lower({x}), '{text.PHONE}', ' ', 'g')"
    greeting = rf"regexp_replace({phone}, '{text.GREETING}', '', 'i')"
    sign_off = text.SIGN_OFF.replace(r"\w*", f"{word}*").replace(r"\s*$", r"[\s\p{Z}\x{b}\x{1c}-\x{1f}\x{85}]*$")
    return _sq(f"regexp_replace({greeting}, '{sign_off}', '', 'i')")


def _spaced(x: str) -> str:
    """The words of a text in lower case, parted by any white space."""
    return rf"list_filter(regexp_split_to_array(lower({x}), '[\t-\r\pZ\x85]+'), lambda w: w <> '')"


def _label(x: str) -> str:
    y = rf"regexp_replace(lower(trim({x})), '[\s\-]+', '_', 'g')"
    return f"(CASE WHEN {y} IN ('routine', 'same_day', 'emergency') THEN {y} END)"


def _rank(x: str) -> str:
    return f"(list_position({LABEL_LIST}, {x}) - 1)"


def _hit(pattern: str) -> str:
    return f"coalesce(regexp_matches(body, '{pattern}', 'i'), false)"


_VULNERABLE = next(p for n, _, p in rules.RULES if n == "vulnerable_occupant")
_HITS = "list_filter([" + ", ".join([f"CASE WHEN {_hit(p)} THEN '{n}' END" for n, _, p in rules.RULES] + [f"CASE WHEN {_hit(_VULNERABLE)} AND {_hit(rules.NO_SERVICE)} THEN '{rules.COMPOUND[0]}' END"]) + "], lambda x: x IS NOT NULL)"
_LEVELS = [(n, x) for n, x, _ in rules.RULES] + [rules.COMPOUND]
_FLOOR = f"(CASE WHEN {_rank('label')} >= 0 THEN {LABEL_LIST}[greatest({_rank('label')}, " + ", ".join(f"CASE WHEN list_contains(hits, '{n}') THEN {text.LABELS.index(x)} ELSE 0 END" for n, x in _LEVELS) + ") + 1] END)"
ANSWERED_SQL = f"""
WITH a AS (
  SELECT m.row_id, m.message_id, m.body, m.created_at, k.body_hash, {_label('k.llm_urgency')} AS label, {_label('k.urgency')} AS urgency, k.score, k.reason, {_HITS} AS hits
  FROM messages m JOIN classifications k ON sha256({_sq('m.body')}) = k.body_hash
), f AS (SELECT *, {_FLOOR} AS floored FROM a)
"""


# --- text -------------------------------------------------------------------------------------------------------------


@query("normalise_hot", f"SELECT row_id, {_sq('body')} AS norm FROM messages")
def normalise_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "messages").select("row_id", text.squeezed(F.col("body")).alias("norm"))


@query("body_hash", f"SELECT row_id, sha256({_sq('body')}) AS hash, coalesce(lower(body_hash) = sha256({_sq('body')}), false) AS is_stored FROM messages")
def body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = text.body_hash(F.col("body"))
    return read(spark, sf_dir, "messages").select("row_id", h.alias("hash"), F.coalesce(F.lower("body_hash") == h, F.lit(False)).alias("is_stored"))


@query("normalise_cold", f"SELECT row_id, {_cold('body')} AS norm FROM messages")
def normalise_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "messages").select("row_id", "body")).select("row_id", text.core_text(F.col("body")).alias("norm"))


@query("core_hash", f"SELECT row_id, sha1({_cold('body')})[1:16] AS core_hash FROM messages")
def core_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "messages").select("row_id", "body")).select("row_id", text.core_hash(F.col("body")).alias("core_hash"))


@query(
    "strip_phone_greeting_signoff",
    rf"SELECT row_id, length(lower(body)) - length(regexp_replace(lower(body), '{text.PHONE}', ' ', 'g')) AS phone_chars, regexp_matches(lower(body), '{text.GREETING}', 'i') AS greets FROM messages",
)
def strip_phone_greeting_signoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("body")
    return read(spark, sf_dir, "messages").select("row_id", (F.length(low) - F.length(text.without_phone(F.col("body")))).alias("phone_chars"), F.rlike(low, F.lit(text.FLAGS + text.GREETING)).alias("greets"))


@query("token_sets", f"SELECT id, list_sort(list_filter(list_distinct(string_split({_sq('body')}, ' ')), lambda w: w <> '')) AS tokens FROM corpus WHERE body IS NOT NULL")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "corpus").where("body IS NOT NULL").select("id", F.array_sort(text.tokens(text.squeezed(F.col("body")))).alias("tokens"))


CHAR_SQL = f"""
WITH w AS (SELECT id, dup_group, ' ' || unnest({_spaced('body')}) || ' ' AS w FROM corpus),
n AS (SELECT id, dup_group, w, unnest([3, 4, 5]) AS n FROM w),
g AS (SELECT id, dup_group, substr(w, CAST(unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) AS INT), n) AS gram FROM n WHERE length(w) >= n OR n = 3),
"""


@query("char_wb_ngrams", CHAR_SQL.rstrip().rstrip(",") + " SELECT gram, count(*) AS n FROM g GROUP BY gram")
def char_wb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "corpus").select(F.explode(text.char_grams(F.col("body"))).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"))


@query(
    "word_bigrams",
    r"""WITH w AS (SELECT regexp_extract_all(lower(body), '[\p{L}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}]{2,}') AS w FROM corpus),
g AS (SELECT unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM w)
SELECT gram, count(*) AS df FROM g GROUP BY gram HAVING count(*) >= 2""",
)
def word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "corpus").select(F.explode(text.word_grams(F.col("body"))).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("df")).where("df >= 2")


# --- rules ------------------------------------------------------------------------------------------------------------


@query("rule_hits", f"SELECT row_id, array_to_string({_HITS}, ',') AS hits FROM messages")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "messages").select("row_id", F.array_join(rules.hits(F.col("body")), ",").alias("hits"))


@query("rule_hit_counts", f"SELECT rule, count(*) AS n FROM (SELECT unnest({_HITS}) AS rule FROM messages) GROUP BY rule")
def rule_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "messages").select(F.explode(rules.hits(F.col("body"))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = read(spark, sf_dir, "messages"), read(spark, sf_dir, "classifications")
    m = spread(m.select("row_id", "message_id", "body", "created_at")).select("row_id", "message_id", "body", "created_at", text.body_hash(F.col("body")).alias("body_hash"), rules.hits(F.col("body")).alias("hits"))
    k = k.select("body_hash", text.plain_label(F.col("llm_urgency")).alias("label"), text.plain_label(F.col("urgency")).alias("urgency"), "score", "reason")
    return m.join(k, "body_hash").withColumn("floored", rules.floor_label(F.col("hits"), F.col("label")))


@query("safety_floor", ANSWERED_SQL + "SELECT row_id, label, floored FROM f")
def safety_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("row_id", "label", "floored")


@query("score_floor_hot", ANSWERED_SQL + "SELECT row_id, CASE WHEN label <> floored THEN greatest(least(score, 100), 0, CASE floored WHEN 'emergency' THEN 80 WHEN 'same_day' THEN 40 ELSE 0 END) ELSE greatest(least(score, 100), 0) END AS score FROM f")
def score_floor_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("row_id", rules.score_if_raised(F.col("score"), F.col("label"), F.col("floored")).alias("score"))


@query("score_floor_cold", ANSWERED_SQL + "SELECT row_id, greatest(CAST(round_even(100 * (1 - (1 - score / 100.0)), 0) AS INT), CASE floored WHEN 'emergency' THEN 80 WHEN 'same_day' THEN 40 ELSE 0 END) AS score FROM f WHERE score IS NOT NULL")
def score_floor_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).where("score IS NOT NULL").select("row_id", rules.score_of_probability(1 - F.col("score") / 100.0, F.col("floored")).alias("score"))


@query("reason_suffix", ANSWERED_SQL + "SELECT row_id, CASE WHEN len(hits) > 0 THEN reason || ' [safety rule: ' || array_to_string(hits, ', ') || ']' ELSE reason END AS reason FROM f")
def reason_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("row_id", rules.reason(F.col("reason"), F.col("hits"), F.lit(True)).alias("reason"))


# --- store ------------------------------------------------------------------------------------------------------------


@query("upsert_messages_first_wins", "SELECT message_id, min(row_id) AS row_id, arg_min(feed_id, row_id) AS feed_id FROM messages WHERE message_id IS NOT NULL GROUP BY message_id")
def upsert_messages_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_first(read(spark, sf_dir, "messages").where("message_id IS NOT NULL").select("row_id", "message_id", "feed_id"), "message_id", "row_id").select("message_id", "row_id", "feed_id")


@query("insert_classifications_absent", f"SELECT hash AS body_hash, min(row_id) AS row_id FROM (SELECT sha256({_sq('body')}) AS hash, row_id FROM messages WHERE body IS NOT NULL) WHERE hash NOT IN (SELECT body_hash FROM classifications) GROUP BY hash")
def insert_classifications_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "messages").where("body IS NOT NULL").select(text.body_hash(F.col("body")).alias("body_hash"), "row_id")
    stored = read(spark, sf_dir, "classifications").select("body_hash", F.lit(None).cast("bigint").alias("row_id"))
    return store.insert_if_absent(stored, m, "body_hash", "row_id").where("row_id IS NOT NULL")


@query("corpus_upsert_override", f"SELECT body_hash, min(id) AS id, arg_min(coalesce(message_id, '-'), id) AS message_id, arg_max(coalesce({_label('urgency')}, '-'), id) AS urgency, arg_max(source, id) AS source FROM corpus WHERE body_hash IS NOT NULL GROUP BY body_hash")
def corpus_upsert_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "corpus").select("id", "body_hash", F.coalesce("message_id", F.lit("-")).alias("message_id"), F.coalesce(text.plain_label(F.col("urgency")), F.lit("-")).alias("urgency"), "source", F.col("id").alias("seq"))
    out = store.upsert_labels(c, "body_hash", "seq", ("urgency", "source"))
    return out.select("body_hash", "id", "message_id", "urgency", "source")


@query("next_dup_group", "SELECT coalesce(max(dup_group), -1) + 1 AS next_group FROM corpus")
def next_dup_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.next_group(read(spark, sf_dir, "corpus"))


@query("corpus_size", "SELECT count(*) AS n FROM corpus")
def corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "corpus").agg(F.count("*").alias("n"))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "messages").where("body IS NOT NULL").select("row_id", text.body_hash(F.col("body")).alias("body_hash"))


HASHED_SQL = f"WITH m AS (SELECT row_id, sha256({_sq('body')}) AS body_hash FROM messages WHERE body IS NOT NULL) "


@query("cache_hits", HASHED_SQL + "SELECT row_id, urgency, model FROM m JOIN classifications USING (body_hash)")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.cache_probe(_hashed(spark, sf_dir), read(spark, sf_dir, "classifications").select("body_hash", "urgency", "model"), "inner").select("row_id", "urgency", "model")


@query("cache_misses", HASHED_SQL + "SELECT body_hash, count(*) AS n FROM m WHERE body_hash NOT IN (SELECT body_hash FROM classifications) GROUP BY body_hash")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    missed = store.cache_probe(_hashed(spark, sf_dir), read(spark, sf_dir, "classifications").select("body_hash"), "left_anti")
    return missed.groupBy("body_hash").agg(F.count("*").alias("n"))


@query("add_label", "SELECT id, row_number() OVER (ORDER BY id) + (SELECT coalesce(max(dup_group), -1) FROM corpus) AS dup_group FROM corpus WHERE source = 'override'")
def add_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "corpus")
    return store.number_new_groups(c.where("source = 'override'").select("id"), c, "id").select("id", F.col("dup_group").cast("bigint").alias("dup_group"))


INBOX = "SELECT row_id, message_id, urgency, score FROM m JOIN messages USING (row_id) {} JOIN classifications k ON m.body_hash = k.body_hash"


def _inbox(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    m = read(spark, sf_dir, "messages").where("body IS NOT NULL").withColumn("body_hash", text.body_hash(F.col("body")))
    return store.inbox(m, read(spark, sf_dir, "classifications"), how)


@query("inbox_by_score", HASHED_SQL + INBOX.format("").replace("SELECT row_id", "SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, messages.created_at, row_id) - 1 AS pos, row_id"))
def inbox_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inbox in order: most urgent first, then by arrival; ``pos`` is the place in it."""
    return grouped.numbered(_inbox(spark, sf_dir, "inner"), *store.by_score()).orderBy("pos").select("pos", "row_id", "message_id", "urgency", "score")


@query("inbox_left_unclassified", HASHED_SQL + INBOX.format("LEFT"))
def inbox_left_unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inbox(spark, sf_dir, "left").select("row_id", "message_id", "urgency", "score")


@query("inbox_all_messages", f"SELECT row_id, message_id, urgency, score FROM messages m LEFT JOIN classifications k ON sha256({_sq('m.body')}) = k.body_hash")
def inbox_all_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As inbox_left_unclassified, but with the messages that have no body."""
    m = read(spark, sf_dir, "messages").withColumn("body_hash", text.body_hash(F.col("body")))
    return store.inbox(m, read(spark, sf_dir, "classifications"), "left").select("row_id", "message_id", "urgency", "score")


_OFFLINE = "CASE WHEN contains(lower(body), 'gas') AND contains(lower(body), 'leak') THEN 'emergency' WHEN contains(lower(body), 'leak') OR contains(lower(body), 'no heating') THEN 'same_day' ELSE 'routine' END"
_INTENT = "CASE WHEN contains(lower(body), 'invoice') OR contains(lower(body), 'bill') THEN '[\"billing\"]' WHEN contains(lower(body), 'quote') THEN '[\"quote\"]' ELSE '[\"other\"]' END"
CLASSIFIED_SQL = f"""
WITH m AS (SELECT row_id, message_id, body, channel, received_at, sha256({_sq('body')}) AS body_hash FROM messages QUALIFY message_id IS NULL OR row_number() OVER (PARTITION BY message_id ORDER BY row_id) = 1),
o AS (SELECT body_hash, arg_min(struct_pack(body := body, channel := channel, received_at := received_at), row_id) AS x, min(row_id) AS row_id FROM m WHERE body IS NOT NULL AND body_hash NOT IN (SELECT body_hash FROM classifications) GROUP BY body_hash),
n AS (SELECT body_hash, row_id, x.body AS body, x.channel AS channel, x.received_at AS received_at FROM o),
k AS (SELECT body_hash, {_label('coalesce(llm_urgency, urgency)')} AS label, intent, score, reason, model, prompt_version, true AS from_cache FROM classifications
  UNION ALL SELECT body_hash, l, {_INTENT}, CASE l WHEN 'emergency' THEN 90 WHEN 'same_day' THEN 50 ELSE 10 END, 'by plain words', 'plain-words', 'v1', false FROM (SELECT body_hash, body, {_OFFLINE} AS l FROM n)),
a AS (SELECT m.row_id, m.message_id, m.body, m.body_hash, k.label, k.intent, k.score, k.reason, k.model, k.prompt_version, k.from_cache, {_HITS} AS hits FROM m LEFT JOIN k USING (body_hash)),
f AS (SELECT *, {_FLOOR} AS floored FROM a),
c AS (SELECT row_id, message_id, body_hash, floored AS urgency, intent,
  CASE WHEN body IS NOT NULL THEN CASE WHEN label <> floored THEN greatest(least(score, 100), 0, CASE floored WHEN 'emergency' THEN 80 WHEN 'same_day' THEN 40 ELSE 0 END) ELSE greatest(0, least(100, score)) END END AS score,
  CASE WHEN label <> floored AND len(hits) > 0 THEN reason || ' [safety rule: ' || array_to_string(hits, ', ') || ']' ELSE reason END AS reason,
  CAST(to_json(hits) AS VARCHAR) AS rule_hits, label AS llm_urgency, model, prompt_version, from_cache FROM f)
"""


@query("classified_end_to_end", CLASSIFIED_SQL.replace("{_HITS}", _HITS) + "SELECT * FROM c")
def classified_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path over all messages, with the offline classifier for cache misses."""
    return classify.classify(read(spark, sf_dir, "messages"), read(spark, sf_dir, "classifications"))


@query("answers_to_store", CLASSIFIED_SQL + "SELECT body_hash, urgency, intent, score, reason, rule_hits, llm_urgency, model, prompt_version FROM c WHERE NOT from_cache QUALIFY row_number() OVER (PARTITION BY body_hash ORDER BY row_id) = 1")
def answers_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fresh answers as rows of the classifications table."""
    return classify.to_store(classified_end_to_end(spark, sf_dir))


@query(
    "override_labels",
    f"""WITH r AS (SELECT id AS seq, message_id, urgency FROM corpus WHERE source = 'override' AND message_id IS NOT NULL),
p AS (SELECT * FROM corpus WHERE source <> 'override'),
f AS (SELECT message_id, arg_min(coalesce(body, '{chr(1)}'), row_id) AS body FROM messages WHERE message_id IS NOT NULL GROUP BY message_id),
x AS (SELECT seq, r.message_id, urgency, body, sha256({_sq('body')}) AS body_hash FROM r JOIN f USING (message_id) WHERE body <> '{chr(1)}'),
l AS (SELECT body_hash, arg_max(coalesce(urgency, '-'), seq) AS urgency, arg_min(message_id, seq) AS message_id, min(seq) AS seq FROM x GROUP BY body_hash),
n AS (SELECT * FROM l WHERE body_hash NOT IN (SELECT body_hash FROM p WHERE body_hash IS NOT NULL))
SELECT p.body_hash, p.message_id, CASE WHEN l.body_hash IS NULL THEN p.urgency ELSE coalesce(nullif(l.urgency, '-'), p.urgency) END AS urgency, p.dup_group, CASE WHEN l.urgency <> '-' THEN 'override' ELSE p.source END AS source FROM p LEFT JOIN l ON p.body_hash = l.body_hash
UNION ALL SELECT body_hash, message_id, nullif(urgency, '-'), row_number() OVER (ORDER BY seq) + (SELECT coalesce(max(dup_group), -1) FROM p), 'override' FROM n""",
)
def override_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of the seed after all corrections that it has as overrides."""
    c = read(spark, sf_dir, "corpus")
    requests = c.where("source = 'override' AND message_id IS NOT NULL").select(F.col("id").alias("seq"), "message_id", "urgency")
    pool, _ = store.add_labels(c.where("source <> 'override'"), read(spark, sf_dir, "messages"), requests)
    return pool.select("body_hash", "message_id", "urgency", "dup_group", "source")


# --- near duplicates --------------------------------------------------------------------------------------------------

SETS_SQL = f"""
WITH RECURSIVE w AS (
  SELECT id, list_sort(list_filter(list_distinct(string_split({_sq('body')}, ' ')), lambda w: w <> '')) AS t FROM corpus WHERE body IS NOT NULL
), s AS (SELECT min(id) AS rep, t FROM w WHERE len(t) > 0 GROUP BY t),
p AS (
  SELECT a.rep AS a, b.rep AS b, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS similarity
  FROM s a JOIN s b ON a.rep < b.rep AND len(list_intersect(a.t, b.t)) > 0.6 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))
), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS other FROM s UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT node, min(other) AS root FROM r GROUP BY node),
g AS (SELECT w.id, c.root FROM w JOIN s USING (t) JOIN c ON s.rep = c.node)
"""


def _corpus_words() -> Column:
    return F.lower(F.col("body"))  # the set join splits it as text.squeezed does


@query("jaccard_pairs", SETS_SQL + "SELECT a, b, round(similarity, 9) AS similarity FROM p")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between representatives of equal word sets; near_dup_groups has the membership."""
    sets = setjoin.encoded_sets(spread(read(spark, sf_dir, "corpus").where("body IS NOT NULL").select("id", "body")), "id", _corpus_words(), members=False)[0]
    return setjoin.near_pairs(sets, 0.6).select("a", "b", F.round("similarity", 9).alias("similarity"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicate_groups(spread(read(spark, sf_dir, "corpus").where("body IS NOT NULL").select("id", "body")), "id", _corpus_words())


@query("near_dup_groups", SETS_SQL + "SELECT id, root FROM g")
def near_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


@query("cluster_sizes", SETS_SQL + ", k AS (SELECT root, count(*) AS size FROM g GROUP BY root) SELECT size, count(*) AS n_groups FROM k GROUP BY size")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).groupBy("root").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


LABELLED_SQL = f"SELECT g.root, g.id, {_label('urgency')} AS label FROM g JOIN corpus USING (id)"


def _labelled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "corpus").select("id", text.plain_label(F.col("urgency")).alias("label"))
    return _groups(spark, sf_dir).join(c, "id")


@query("contradictory_clusters", SETS_SQL + f", l AS ({LABELLED_SQL}) SELECT root, count(DISTINCT label) AS n_labels, count(*) AS n_rows FROM l GROUP BY root HAVING count(DISTINCT label) > 1")
def contradictory_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_groups(spark, sf_dir).groupBy("root").agg(F.count_distinct("label").alias("n_labels"), F.count("*").alias("n_rows")).where("n_labels > 1")


SEED_SQL = SETS_SQL.replace("FROM corpus WHERE body IS NOT NULL", f"FROM corpus WHERE body IS NOT NULL AND {_label('urgency')} IS NOT NULL")


@query("seed_corpus", SEED_SQL + f", l AS ({LABELLED_SQL}), k AS (SELECT root, min(id) AS id, min(label) AS label FROM l GROUP BY root HAVING count(DISTINCT label) = 1) SELECT id, label, row_number() OVER (ORDER BY id) - 1 AS dup_group FROM k")
def seed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representative of each group of labelled rows whose labels agree, with a dense group number; groups that contradict are dropped."""
    c = read(spark, sf_dir, "corpus").select("id", "body", text.plain_label(F.col("urgency")).alias("label")).where("body IS NOT NULL AND label IS NOT NULL")
    g = setjoin.near_duplicate_groups(c, "id", _corpus_words()).join(c.select("id", "label"), "id")
    g = g.groupBy("root").agg(F.min("id").alias("id"), F.min("label").alias("label"), F.count_distinct("label").alias("k"))
    return grouped.numbered(g.where("k = 1").select("id", "label"), F.col("id")).select("id", "label", F.col("pos").alias("dup_group"))


@query("deconflict_upward", f"SELECT core_hash, arg_max(row_id, {{'r': {_rank('label')}, 'i': -row_id}}) AS row_id, max({_rank('label')}) AS rank FROM (SELECT core_hash, row_id, {_label('label')} AS label FROM combined) WHERE label IS NOT NULL AND core_hash IS NOT NULL GROUP BY core_hash")
def deconflict_upward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with the most urgent label of each core_hash, the first of equals."""
    b = read(spark, sf_dir, "combined").select("core_hash", "row_id", text.rank(text.plain_label(F.col("label"))).alias("rank")).where("rank IS NOT NULL AND core_hash IS NOT NULL")
    return b.groupBy("core_hash").agg(F.max_by("row_id", F.struct("rank", -F.col("row_id"))).alias("row_id"), F.max("rank").alias("rank"))


@query("conflict_count", f"SELECT count(*) AS n FROM (SELECT core_hash FROM combined WHERE core_hash IS NOT NULL GROUP BY core_hash HAVING count(DISTINCT {_label('label')}) > 1)")
def conflict_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "combined").where("core_hash IS NOT NULL").groupBy("core_hash").agg(F.count_distinct(text.plain_label(F.col("label"))).alias("k"))
    return b.where("k > 1").agg(F.count("*").alias("n"))


GOLD_SQL = f"""
WITH RECURSIVE b AS (SELECT row_id AS id, {_rank(_label('c.label'))} AS r, m.body FROM combined c JOIN messages m USING (row_id) WHERE label_source IN ('gold_train', 'gold_test') AND {_label('c.label')} IS NOT NULL),
w AS (SELECT id, list_sort(list_filter(list_distinct(string_split({_cold('body')}, ' ')), lambda w: w <> '')) AS t FROM b WHERE body IS NOT NULL),
s AS (SELECT min(id) AS rep, t FROM w WHERE len(t) > 0 GROUP BY t),
e AS (SELECT x.rep AS a, y.rep AS b FROM s x JOIN s y ON x.rep <> y.rep AND len(list_intersect(x.t, y.t)) > 0.6 * (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))),
r AS (SELECT rep AS node, rep AS other FROM s UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT node, min(other) AS root FROM r GROUP BY node),
g AS (SELECT b.id, b.r, coalesce(c.root, -1) AS root FROM b LEFT JOIN w USING (id) LEFT JOIN s USING (t) LEFT JOIN c ON s.rep = c.node),
h AS (SELECT root, max(r) AS stratum, count(*) AS n FROM g GROUP BY root),
f AS (SELECT root, CASE WHEN (row_number() OVER (ORDER BY stratum DESC, n DESC, root) - 1) % 4 IN (0, 3) THEN 0 ELSE 1 END AS fold FROM h)
"""


@query("grouped_split", GOLD_SQL + "SELECT id, root, fold FROM g JOIN f USING (root)")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of the rows labelled by hand, in which near duplicates stay together and labels and sizes are spread alike."""
    rows = _training(spark, sf_dir).where(F.col("label_source").isin("gold_train", "gold_test"))
    return grouped.disjoint(checkpointed(grouped.halves(rows, text.core(F.col("body")))))


@query("preprocessed_train")
def preprocessed_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table of the preparation plan, as written and read; rows with an id divisible by 50 ask for a pseudo label."""
    b = read(spark, sf_dir, "combined").select("row_id", F.when(F.col("label_source").isin("gold_train", "gold_test"), F.col("label")).alias("gold_label"), F.coalesce("source", F.lit("messages")).alias("source"))
    m = read(spark, sf_dir, "messages").select("row_id", "message_id", "received_at", "channel", "from_name", "body")
    folder = scratch(spark, "prepared")
    preprocess.write(preprocess.preprocess(b.join(m, "row_id"), F.col("row_id") % 50 == 0), folder)
    return spark.read.parquet(f"{folder}/train").select("row_id", "core_hash", "label", "label_source", "confidence")


# --- retrieval --------------------------------------------------------------------------------------------------------

IDF_SQL = CHAR_SQL + """
n_docs AS (SELECT count(DISTINCT id) AS n FROM g),
d AS (SELECT gram, count(DISTINCT id) AS df FROM g GROUP BY gram),
i AS (SELECT gram, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM d, n_docs),
"""
TOP_SQL = IDF_SQL + """
t AS (SELECT id, dup_group, gram, count(*) * any_value(idf) AS w FROM g JOIN i USING (gram) GROUP BY id, dup_group, gram),
v AS (SELECT id, dup_group, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM t),
s AS (SELECT q.id AS query_id, v.id, round(sum(q.w * v.w), 9) AS sim FROM v q JOIN v USING (gram)
  WHERE q.id % 50 = 0 AND q.id <> v.id AND {guard} GROUP BY q.id, v.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
"""
GUARD = "(q.dup_group IS NULL OR v.dup_group IS NULL OR q.dup_group <> v.dup_group)"


def _top(spark: SparkSession, sf_dir: str, guarded: bool, k: int = 3) -> DataFrame:
    group = F.col("dup_group") if guarded else F.lit(None).cast("bigint")
    rows = retrieval.texts_of(spread(read(spark, sf_dir, "corpus").select("id", group.alias("grp"), "body")))
    return retrieval.nearest_texts(rows.where("id % 50 = 0"), rows, k)


@query("tfidf_idf", IDF_SQL.rstrip().rstrip(",") + " SELECT gram, df, round(idf, 9) AS idf FROM i")
def tfidf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spread(read(spark, sf_dir, "corpus").select("id", "body")).select("id", F.explode(text.char_grams(F.col("body"))).alias("gram"))
    return retrieval.idf(g).select("gram", "df", F.round("idf", 9).alias("idf"))


@query("retrieve_top3", TOP_SQL.format(guard="true") + "SELECT query_id, id, round(sim, 6) AS sim, rank FROM k WHERE rank <= 3")
def retrieve_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all rows whose id is divisible by 50, against all rows."""
    return _top(spark, sf_dir, False).select("query_id", "id", F.round("sim", 6).alias("sim"), "rank")


@query("retrieve_top3_leave_group_out", TOP_SQL.format(guard=GUARD) + "SELECT query_id, id, round(sim, 6) AS sim, rank FROM k WHERE rank <= 3")
def retrieve_top3_leave_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As retrieve_top3, but no row of the query's own dup_group."""
    return _top(spark, sf_dir, True).select("query_id", "id", F.round("sim", 6).alias("sim"), "rank")


@query("nn1_label", TOP_SQL.format(guard=GUARD) + f"SELECT k.query_id, {_label('urgency')} AS label FROM k JOIN corpus c USING (id) WHERE rank = 1")
def nn1_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "corpus").select("id", text.plain_label(F.col("urgency")).alias("label"))
    return _top(spark, sf_dir, True, 1).join(c, "id").select("query_id", "label")


@query(
    "few_shot_prompt",
    TOP_SQL.format(guard=GUARD)
    + f"""SELECT query_id, count(*) AS n_shots, sha256(string_agg('Example (labelled ' || coalesce({_label('c.urgency')}, 'none') || ' by the office manager):' || chr(10) || coalesce(c.body, '') || chr(10), chr(10) ORDER BY rank)
  || chr(10) || 'Message to classify:' || chr(10) || 'channel: ' || coalesce(any_value(m.channel), '') || chr(10) || 'received: ' || coalesce(any_value(m.received_at), '') || chr(10) || any_value(coalesce(q.body, ''))) AS prompt_hash
FROM k JOIN corpus c USING (id) JOIN corpus q ON q.id = k.query_id LEFT JOIN (SELECT message_id, arg_min(coalesce(channel, ''), row_id) AS channel, arg_min(coalesce(received_at, ''), row_id) AS received_at FROM messages GROUP BY message_id) m ON m.message_id = q.message_id
WHERE rank <= 3 GROUP BY query_id""",
)
def few_shot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each query: its examples in order of similarity, then the message with channel and time (hashed here)."""
    c = read(spark, sf_dir, "corpus")
    m = store.keep_first(read(spark, sf_dir, "messages").where("message_id IS NOT NULL").select("row_id", "message_id", "channel", "received_at"), "message_id", "row_id")
    asked = c.select(F.col("id").alias("query_id"), "message_id", "body").join(m.drop("row_id"), "message_id", "left")
    x = classify.shots_of(_top(spark, sf_dir, True), c).join(asked, "query_id")
    return x.select("query_id", F.size("shots").cast("bigint").alias("n_shots"), F.sha2(classify.prompt(F.col("shots"), F.col("channel"), F.col("received_at"), F.col("body")), 256).alias("prompt_hash"))


DENSE_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, round(list_cosine_similarity(q.e, v.e), 9) AS sim FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s QUALIFY rank <= 5),
w AS (SELECT query_id, label, sum(sim) AS w, max(sim) AS top FROM k GROUP BY query_id, label),
b AS (SELECT query_id, max(top) AS top, sum(w) AS total, arg_max({'l': label, 'w': w}, {'w': round(w, 6), 'l': label}) AS best FROM w GROUP BY query_id)
"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dense_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("knn_vote_dense", DENSE_SQL + "SELECT query_id, best.l AS label, round(best.w / total, 6) AS confidence FROM b")
def knn_vote_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vote(_dense(spark, sf_dir), -1.0)


@query("knn_vote_abstain", DENSE_SQL + "SELECT query_id, CASE WHEN top >= 0.35 THEN best.l END AS label, CASE WHEN top >= 0.35 THEN round(best.w / total, 6) END AS confidence FROM b")
def knn_vote_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vote(_dense(spark, sf_dir), 0.35)


POOL_SQL = f"""
WITH r AS (SELECT b.row_id AS id, b.label_source, {_label('b.label')} AS label, m.body FROM combined b JOIN messages m USING (row_id)),
w AS (SELECT id, ' ' || unnest({_spaced('body')}) || ' ' AS w FROM r),
n AS (SELECT id, w, unnest([3, 4, 5]) AS n FROM w),
g AS (SELECT id, substr(w, CAST(unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) AS INT), n) AS gram FROM n WHERE length(w) >= n OR n = 3),
n_docs AS (SELECT count(DISTINCT id) AS n FROM g), d AS (SELECT gram, count(DISTINCT id) AS df FROM g GROUP BY gram),
i AS (SELECT gram, ln((1 + n) / (1 + df)) + 1 AS idf FROM d, n_docs),
t AS (SELECT id, gram, count(*) * any_value(idf) AS w FROM g JOIN i USING (gram) GROUP BY id, gram),
v AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM t),
s AS (SELECT q.id AS query_id, v.id, round(sum(q.w * v.w), 9) AS sim FROM v q JOIN v USING (gram)
  WHERE q.id IN (SELECT id FROM r WHERE id % 50 = 0 AND label_source = 'none') AND v.id IN (SELECT id FROM r WHERE label_source = 'gold_train' AND label IS NOT NULL) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s QUALIFY rank <= 5),
x AS (SELECT query_id, label, sum(sim) AS w, max(sim) AS top FROM k JOIN r USING (id) GROUP BY ALL),
b AS (SELECT query_id, max(top) AS top, sum(w) AS total, arg_max({{'l': label, 'w': w}}, {{'w': round(w, 6), 'r': {_rank('label')}}}) AS best FROM x GROUP BY query_id)
SELECT query_id, CASE WHEN top >= 0.6 THEN best.l END AS label, CASE WHEN top >= 0.6 THEN round(best.w / total, 5) END AS confidence FROM b
"""


@query("pseudo_labels", POOL_SQL)
def pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for unlabelled rows (id divisible by 50) by the vote of their five nearest gold training rows; none below 0.6."""
    b = read(spark, sf_dir, "combined").select(F.col("row_id").alias("id"), "label_source", text.plain_label(F.col("label")).alias("label"))
    rows = b.join(read(spark, sf_dir, "messages").select(F.col("row_id").alias("id"), "body"), "id")
    v = checkpointed(retrieval.texts_of(rows.select("id", F.lit(None).cast("bigint").alias("grp"), "body")))
    gold = b.where("label_source = 'gold_train' AND label IS NOT NULL").select("id", "label")
    asked = b.where("id % 50 = 0 AND label_source = 'none'").select("id")
    near = retrieval.nearest_texts(v.join(asked, "id", "left_semi"), v.join(gold, "id", "left_semi"), 5, v).join(gold, "id")
    out = retrieval.vote(near, 0.6, text.rank(F.col("label")))
    return out.select("query_id", "label", F.round("confidence", 5).alias("confidence"))


# --- calibration ------------------------------------------------------------------------------------------------------

GRID_SQL = """
WITH p AS (SELECT score / 100.0::DOUBLE AS p FROM classifications WHERE score IS NOT NULL),
t AS (SELECT round(0.05 + 0.005 * unnest(range(181)), 3)::DOUBLE AS threshold),
grid AS (SELECT threshold, count(p) AS flagged, round(count(p) / (SELECT count(*) FROM p) * 90.0, 6) AS alerts_per_day FROM t LEFT JOIN p ON p.p >= t.threshold - 5e-12 GROUP BY threshold)
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "classifications").select((F.col("score") / 100.0).alias("p"))


@query("flags_per_day_grid", GRID_SQL + "SELECT * FROM grid")
def flags_per_day_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.alert_grid(_scores(spark, sf_dir))


@query("alert_threshold", GRID_SQL + "SELECT min(threshold) AS threshold FROM grid WHERE alerts_per_day <= 10")
def alert_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.alert_threshold(_scores(spark, sf_dir))


MESSAGES_GRID_SQL = GRID_SQL.replace("FROM classifications WHERE", f"FROM messages m JOIN classifications k ON sha256({_sq('m.body')}) = k.body_hash WHERE")


def _message_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p of each answer and n, the number of messages that have it. Messages without an answer have no score."""
    n = _hashed(spark, sf_dir).groupBy("body_hash").agg(F.count("*").alias("n"))
    return n.join(read(spark, sf_dir, "classifications").select("body_hash", (F.col("score") / 100.0).alias("p")), "body_hash").select("p", "n")


@query("flags_per_day_grid_messages", MESSAGES_GRID_SQL + "SELECT * FROM grid")
def flags_per_day_grid_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As flags_per_day_grid, but the share is that of all messages, repeats included, not of distinct answers."""
    return metrics.alert_grid(_message_scores(spark, sf_dir), messages="n")


@query("alert_threshold_messages", MESSAGES_GRID_SQL + "SELECT min(threshold) AS threshold FROM grid WHERE alerts_per_day <= 10")
def alert_threshold_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As alert_threshold, over all messages."""
    return metrics.alert_threshold(_message_scores(spark, sf_dir), messages="n")


# --- evaluation -------------------------------------------------------------------------------------------------------

PAIRS_SQL = f"""
WITH x AS (
  SELECT b.row_id, {_label('b.label')} AS truth, {_label('k.urgency')} AS final, {_label('k.llm_urgency')} AS label, {_HITS.replace('body,', 'm.body,')} AS hits, k.score
  FROM combined b JOIN messages m USING (row_id) LEFT JOIN classifications k ON sha256({_sq('m.body')}) = k.body_hash
  WHERE b.label_source IN ('gold_train', 'gold_test')
), y AS (SELECT row_id, truth, final, label, score, {_FLOOR} AS floored, {_FLOOR.replace(_rank('label'), '0')} AS by_rules FROM x),
z AS (SELECT row_id, truth, 'always_routine' AS system, 'routine' AS predicted FROM y UNION ALL SELECT row_id, truth, 'rules_only', by_rules FROM y
  UNION ALL SELECT row_id, truth, 'model', label FROM y UNION ALL SELECT row_id, truth, 'stored', final FROM y UNION ALL SELECT row_id, truth, 'model_and_rules', floored FROM y)
"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "combined").where(F.col("label_source").isin("gold_train", "gold_test")).select("row_id", text.plain_label(F.col("label")).alias("truth"))
    m = spread(read(spark, sf_dir, "messages").select("row_id", "body")).select("row_id", text.body_hash(F.col("body")).alias("body_hash"), rules.hits(F.col("body")).alias("hits"))
    k = read(spark, sf_dir, "classifications").select("body_hash", text.plain_label(F.col("urgency")).alias("final"), text.plain_label(F.col("llm_urgency")).alias("label"), "score")
    x = b.join(m, "row_id").join(k, "body_hash", "left")
    return x.withColumns({"floored": rules.floor_label(F.col("hits"), F.col("label")), "by_rules": rules.floor_label(F.col("hits"), F.lit("routine"))})


def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluated row once a system, in long form, from one scan."""
    each = F.array(*[F.struct(F.lit(n).alias("system"), c.alias("predicted")) for n, c in (("always_routine", F.lit("routine")), ("rules_only", F.col("by_rules")), ("model", F.col("label")), ("stored", F.col("final")), ("model_and_rules", F.col("floored")))])
    return _evaluated(spark, sf_dir).select("row_id", "truth", F.explode(each).alias("x")).select("row_id", "truth", "x.system", "x.predicted")


def _stored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("row_id", "truth", F.col("final").alias("predicted"))


@query("confusion_matrix", PAIRS_SQL + f", c AS (SELECT unnest({LABEL_LIST}) AS l) SELECT a.l AS truth, b.l AS predicted, (SELECT count(*) FROM y WHERE y.truth = a.l AND y.final = b.l) AS n FROM c a, c b")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_stored_pairs(spark, sf_dir))


@query(
    "class_recall_wilson",
    PAIRS_SQL
    + """, k AS (SELECT truth, count(*) FILTER (truth = final) AS hits, count(*) AS n FROM y WHERE truth IS NOT NULL GROUP BY truth),
p AS (SELECT *, hits / n AS p, 1.96 * 1.96 AS z2 FROM k)
SELECT truth, hits, n, round(p, 6) AS recall, round(greatest(0, (p + z2 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS low,
round(least(1, (p + z2 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS high FROM p""",
)
def class_recall_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall(_stored_pairs(spark, sf_dir))


@query(
    "scoreboard",
    PAIRS_SQL
    + """SELECT system, count(*) AS n, round(avg(CASE WHEN truth = predicted THEN 1 ELSE 0 END), 6) AS accuracy,
count(*) FILTER (truth = 'emergency' AND predicted = 'emergency') AS emergency_hits, count(*) FILTER (truth = 'emergency') AS emergencies,
count(*) FILTER (truth = 'same_day' AND predicted = 'same_day') AS same_day_hits, count(*) FILTER (truth = 'same_day') AS same_days,
count(*) FILTER (truth = 'routine' AND predicted <> 'routine') AS false_alarms, count(*) FILTER (truth = 'routine') AS routines FROM z WHERE truth IS NOT NULL GROUP BY system""",
)
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scoreboard(_systems(spark, sf_dir))


@query("downgrades", PAIRS_SQL + f"SELECT row_id, system, truth, predicted FROM z WHERE {_rank('predicted')} < {_rank('truth')}")
def downgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _systems(spark, sf_dir).where(text.rank(F.col("predicted")) < text.rank(F.col("truth"))).select("row_id", "system", "truth", "predicted")


@query("disagreements", PAIRS_SQL + "SELECT row_id, truth, label, floored FROM y WHERE label <> floored OR label <> final")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).where("label <> floored OR label <> final").select("row_id", "truth", "label", "floored")


@query("hot_cold_crosstab", PAIRS_SQL + f"SELECT coalesce(final, 'none') AS hot, count(*) FILTER (label = 'routine') AS routine, count(*) FILTER (label = 'same_day') AS same_day, count(*) FILTER (label = 'emergency') AS emergency, count(*) FILTER (label IS NULL) AS none FROM y GROUP BY ALL")
def hot_cold_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored label of each evaluated row against that of the model alone."""
    x = _evaluated(spark, sf_dir).select(F.coalesce("final", F.lit("none")).alias("hot"), F.coalesce("label", F.lit("none")).alias("cold"))
    return x.groupBy("hot").pivot("cold", [*text.LABELS, "none"]).count().na.fill(0)


@query("disagreement_rate", PAIRS_SQL + "SELECT count(*) FILTER (label <> final) AS n_differ, count(*) AS n, round(count(*) FILTER (label <> final) * 90.0 / count(*), 6) AS per_day FROM y WHERE label IS NOT NULL AND final IS NOT NULL")
def disagreement_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on which the stored label and that of the model differ, and how many a day that makes."""
    x = _evaluated(spark, sf_dir).where("label IS NOT NULL AND final IS NOT NULL").agg(F.count_if(F.col("label") != F.col("final")).alias("n_differ"), F.count("*").alias("n"))
    return x.select("n_differ", "n", F.round(F.try_divide(F.col("n_differ") * F.lit(float(metrics.PER_DAY)), F.col("n")), 6).alias("per_day"))


@query("conflict_members", f"WITH b AS (SELECT row_id, core_hash, {_label('label')} AS label FROM combined WHERE core_hash IS NOT NULL) SELECT core_hash, row_id, label, left(body, 90) AS body FROM b JOIN messages USING (row_id) WHERE label IS NOT NULL AND core_hash IN (SELECT core_hash FROM b GROUP BY core_hash HAVING count(DISTINCT label) > 1)")
def conflict_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rows of each core_hash with contradicting labels, with the start of their text for a report."""
    b = read(spark, sf_dir, "combined").where("core_hash IS NOT NULL").select("row_id", "core_hash", text.plain_label(F.col("label")).alias("label"))
    torn = b.groupBy("core_hash").agg(F.count_distinct("label").alias("k")).where("k > 1").select("core_hash")
    m = read(spark, sf_dir, "messages").select("row_id", F.substring("body", 1, 90).alias("body"))
    return b.where("label IS NOT NULL").join(torn, "core_hash", "left_semi").join(m, "row_id").select("core_hash", "row_id", "label", "body")


@query("rank_error_counts", PAIRS_SQL + f"SELECT {_rank('final')} - {_rank('truth')} AS off_by, count(*) AS n FROM y WHERE final IS NOT NULL AND truth IS NOT NULL GROUP BY ALL")
def rank_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rank_errors(_stored_pairs(spark, sf_dir))


@query("recall_at_budget", GRID_SQL.rstrip() + ", " + PAIRS_SQL.strip().removeprefix("WITH ") + "SELECT truth, count(*) FILTER (score / 100.0 >= (SELECT min(threshold) FROM grid WHERE alerts_per_day <= 10) - 5e-12) AS flagged, count(*) AS n FROM y WHERE truth IS NOT NULL GROUP BY truth")
def recall_at_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall_at(spark, sf_dir, metrics.alert_threshold(_scores(spark, sf_dir)))


def _recall_at(spark: SparkSession, sf_dir: str, t: DataFrame) -> DataFrame:
    x = _evaluated(spark, sf_dir).where("truth IS NOT NULL").crossJoin(F.broadcast(t))  # one row
    return x.groupBy("truth").agg(F.count_if(F.col("score") / 100.0 >= F.col("threshold") - 5e-12).alias("flagged"), F.count("*").alias("n"))


@query("recall_at_budget_messages", MESSAGES_GRID_SQL.rstrip() + ", " + PAIRS_SQL.strip().removeprefix("WITH ") + "SELECT truth, count(*) FILTER (score / 100.0 >= (SELECT min(threshold) FROM grid WHERE alerts_per_day <= 10) - 5e-12) AS flagged, count(*) AS n FROM y WHERE truth IS NOT NULL GROUP BY truth")
def recall_at_budget_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As recall_at_budget, at the threshold over all messages."""
    return _recall_at(spark, sf_dir, metrics.alert_threshold(_message_scores(spark, sf_dir), messages="n"))


@query("miss_report", PAIRS_SQL + f"SELECT row_id, bool_or({_rank('predicted')} < {_rank('truth')}) AS missed, count(*) FILTER ({_rank('predicted')} < {_rank('truth')}) AS n_low FROM z WHERE predicted IS NOT NULL AND truth IS NOT NULL GROUP BY row_id")
def miss_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the number of systems that rank them too low."""
    low = text.rank(F.col("predicted")) < text.rank(F.col("truth"))
    return _systems(spark, sf_dir).where("predicted IS NOT NULL AND truth IS NOT NULL").groupBy("row_id").agg(F.bool_or(low).alias("missed"), F.count_if(low).alias("n_low"))


@query("predictions", f"SELECT message_id, urgency, score, reason, 'hot' AS source FROM messages m JOIN classifications k ON sha256({_sq('m.body')}) = k.body_hash")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions table: the messages that have a stored answer."""
    return files.predictions(read(spark, sf_dir, "messages"), read(spark, sf_dir, "classifications"))


@query("systems_by_rank", PAIRS_SQL + f"SELECT system AS channel, count(*) AS n, count(*) FILTER ({_rank('predicted')} = {_rank('truth')}) AS exact, count(*) FILTER ({_rank('predicted')} < {_rank('truth')}) AS under, count(*) FILTER ({_rank('predicted')} > {_rank('truth')}) AS over FROM z GROUP BY system")
def systems_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each system ranks exactly, too low, too high, as the trap report counts."""
    return metrics.trap_counts(_systems(spark, sf_dir).select(F.col("system").alias("channel"), F.col("truth").alias("expected"), "predicted"))


@query("label_source_crosstab", f"SELECT coalesce(label_source, '(none)') AS label_source, count(*) FILTER (l = 'routine') AS routine, count(*) FILTER (l = 'same_day') AS same_day, count(*) FILTER (l = 'emergency') AS emergency, count(*) FILTER (l IS NULL) AS none FROM (SELECT label_source, {_label('label')} AS l FROM combined) GROUP BY ALL")
def label_source_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "combined").select(F.coalesce("label_source", F.lit("(none)")).alias("label_source"), F.coalesce(text.plain_label(F.col("label")), F.lit("none")).alias("l"))
    return b.groupBy("label_source").pivot("l", [*text.LABELS, "none"]).count().na.fill(0)


# --- loading ----------------------------------------------------------------------------------------------------------


@query("parse_two_date_formats", r"SELECT row_id, coalesce(strftime(try_strptime(received_at, '%Y-%m-%d %H:%M'), '%Y-%m-%dT%H:%M:%S'), strftime(try_strptime(received_at, '%d/%m/%Y %H:%M:%S'), '%Y-%m-%dT%H:%M:%S')) AS iso FROM messages WHERE regexp_full_match(received_at, '\d{4}-\d\d-\d\d \d\d:\d\d') OR regexp_full_match(received_at, '\d\d?/\d\d?/\d{4} \d\d?:\d\d:\d\d')")
def parse_two_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "messages").where(F.col("received_at").rlike(r"^(\d{4}-\d\d-\d\d \d\d:\d\d|\d\d?/\d\d?/\d{4} \d\d?:\d\d:\d\d)$"))
    return m.select("row_id", F.coalesce(files.iso(F.col("received_at"), files.YEAR_FIRST), files.iso(F.col("received_at"), files.DAY_FIRST)).alias("iso"))


@query("union_sources", "SELECT source, count(*) AS n, count(label) AS labelled FROM (SELECT 'messages' AS source, label FROM combined WHERE source = 'messages' UNION ALL SELECT 'holdout', NULL FROM combined WHERE source = 'holdout') GROUP BY source")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "combined")
    both = files.union(b.where("source = 'messages'").select("source", "label"), b.where("source = 'holdout'").select("source", F.lit(None).cast("string").alias("label")))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("label").alias("labelled"))


@query("labelled_only", "SELECT row_id, label FROM combined WHERE label IN ('routine', 'same_day', 'emergency')")
def labelled_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.labelled(read(spark, sf_dir, "combined"), "label").select("row_id", "label")


@query("value_counts", f"SELECT coalesce({_label('urgency')}, 'none') AS urgency, model, prompt_version, count(*) AS n FROM classifications GROUP BY ALL")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "classifications").groupBy(F.coalesce(text.plain_label(F.col("urgency")), F.lit("none")).alias("urgency"), "model", "prompt_version").agg(F.count("*").alias("n"))


@query("intent_counts", "SELECT intent, count(*) AS n FROM (SELECT unnest(CAST(from_json(intent, '[\"VARCHAR\"]') AS VARCHAR[])) AS intent FROM classifications) GROUP BY intent")
def intent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.explode(F.from_json("intent", "array<string>"))
    return read(spark, sf_dir, "classifications").select(i.alias("intent")).groupBy("intent").agg(F.count("*").alias("n"))


@query("score_bands", f"SELECT model, {_label('urgency')} AS urgency, min(score) AS lowest, max(score) AS highest, count(*) AS n FROM classifications GROUP BY ALL")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores that each model gave with each label."""
    k = read(spark, sf_dir, "classifications").groupBy("model", text.plain_label(F.col("urgency")).alias("urgency"))
    return k.agg(F.min("score").alias("lowest"), F.max("score").alias("highest"), F.count("*").alias("n"))


_BROKEN = "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({sql}, false) THEN '{name}' END" for name, sql in schema.CHECKS["corpus"].items()) + "], lambda x: x IS NOT NULL)"


@query("quarantined_corpus", f"SELECT array_to_string(b, ',') AS broken, count(*) AS n FROM (SELECT {_BROKEN} AS b FROM corpus) WHERE len(b) > 0 GROUP BY ALL")
def quarantined_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the retrieval pool that break a condition, counted by which."""
    return schema.quarantined(read(spark, sf_dir, "corpus"), "corpus").groupBy(F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))


# --- models and streams -----------------------------------------------------------------------------------------------


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "messages").select("row_id", "body")
    return read(spark, sf_dir, "combined").select("row_id", "core_hash", text.plain_label(F.col("label")).alias("label"), "label_source").join(m, "row_id")


@query("cold_model_predictions")
def cold_model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier fitted on gold training rows, of each core_hash the most urgent, applied to all rows, raised by rules."""
    rows = _training(spark, sf_dir)
    out = model.scored(model.fit(retrain.most_urgent(rows.where("label_source = 'gold_train'"))), rows.select("row_id", "body", "label"))
    # fenced: the patterns would be copied for each use of the hits and of the final label, 18 times in all
    out = fenced(out.select("row_id", "label", "predicted", "p_urgent", rules.hits(F.col("body")).alias("hits")))
    out = fenced(out.select("row_id", "label", "predicted", "p_urgent", rules.floor_label(F.col("hits"), F.col("predicted")).alias("final")))
    return out.select("row_id", "label", "predicted", "final", rules.score_of_probability(1 - F.col("p_urgent"), F.col("final")).alias("score"))


@query("oof_scores")
def oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of the gold rows, by models fitted on the most urgent row of each core_hash in the other folds."""
    rows = _training(spark, sf_dir).where(F.col("label_source").isin("gold_train", "gold_test") & F.col("label").isNotNull())
    return model.out_of_fold(rows, prepare=retrain.most_urgent).select("row_id", "fold", "label", "predicted", F.round("p_urgent", 6).alias("p_urgent"))


@query("stream_ingest_once", f"""
WITH m AS (SELECT row_id, message_id, body, sha256({_sq('body')}) AS body_hash FROM messages QUALIFY message_id IS NULL OR row_number() OVER (PARTITION BY message_id ORDER BY row_id) = 1),
a AS (SELECT m.*, {_label('k.llm_urgency')} AS label, {_HITS} AS hits FROM m LEFT JOIN classifications k USING (body_hash))
SELECT row_id, message_id, body_hash, label, array_to_string(hits, ',') AS rule_hits, {_FLOOR} AS final_label FROM a""")
def stream_ingest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the message files until nothing is left; each message_id comes out once, as its first row."""
    folder = scratch(spark, "stream")
    stream = ingest.ingest(ingest.arriving(spark, f"{sf_dir}/messages.parquet", 2), read(spark, sf_dir, "classifications"))
    ingest.run_once(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("row_id", "message_id", "body_hash", "label", "rule_hits", "final_label")
