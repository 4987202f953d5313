"""The classification path as one plan: keep first, hash, cache, prompt, answer the misses once a hash, raise by rules, rows to store.

The key of a stored answer is its hash, or its hash, model and prompt version where those are given. A classifier is a
plain callable over a frame of distinct misses (body, prompt); a hosted model takes the prompt, the offline one the body.
Answers that don't meet the response contract are asked for again, only those and after a pause; what stays bad is set
apart with the error as reason and no label, so that one bad answer costs nothing but itself.

Edge cases: messages without a body come out with null answer and from_cache; repeated message_ids count once, the first
row_id; messages without an id all stay; an empty corpus gives prompts without examples.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LABELS, body_hash, plain_label
from ..operators import rules, store

# The intents an answer may have, and the wording of a prompt.
INTENTS = ("quote", "booking", "billing", "complaint", "job_update", "other")
SHOT = ("Example (labelled ", " by the office manager):\n", "\n")
ASKED = ("Message to classify:\nchannel: ", "\nreceived: ", "\n")

Classifier = Callable[[pd.DataFrame], list[tuple[str, list[str], int, str]]]
ATTEMPTS, PAUSE_S = 3, 1.0
OFFLINE, PROMPT_VERSION = "plain-words", "v1"


def offline_classifier(asked: pd.DataFrame) -> list[tuple[str, list[str], int, str]]:
    """A deterministic stand-in for a hosted model: (label, intents, score, reason) of each body, by plain words."""
    out = []
    for text in asked["body"]:
        low = text.lower()
        label = "emergency" if "gas" in low and "leak" in low else "same_day" if "leak" in low or "no heating" in low else "routine"
        intents = ["billing"] if "invoice" in low or "bill" in low else ["quote"] if "quote" in low else ["other"]
        out.append((label, intents, {"routine": 10, "same_day": 50, "emergency": 90}[label], "by plain words"))
    return out


def prompt(shots: Column, channel: Column, received_at: Column, body: Column) -> Column:
    """The retrieved examples (array of label, body in order) and the message to classify, as one text."""
    each = F.transform(F.coalesce(shots, F.array().cast("array<struct<label:string,body:string>>")), lambda s: F.concat(F.lit(SHOT[0]), F.coalesce(s["label"], F.lit("none")), F.lit(SHOT[1]), F.coalesce(s["body"], F.lit("")), F.lit(SHOT[2])))
    text = lambda c: F.coalesce(c, F.lit(""))
    asked = F.concat(F.lit(ASKED[0]), text(channel), F.lit(ASKED[1]), text(received_at), F.lit(ASKED[2]), text(body))
    return F.array_join(F.concat(each, F.array(asked)), "\n")


def shots_of(near: DataFrame, corpus: DataFrame, key: str = "query_id") -> DataFrame:
    """key, shots: the examples of each query in order of rank, from near (key, id, rank) and corpus (id, urgency, body)."""
    c = corpus.select("id", plain_label(F.col("urgency")).alias("label"), "body")
    s = near.join(c, "id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "label", "body"))).alias("_s"))  # k rows a query
    return s.select(key, F.transform("_s", lambda x: F.struct(x["label"].alias("label"), x["body"].alias("body"))).alias("shots"))


def _bad(answer: tuple) -> str | None:
    """Why an answer doesn't meet the contract, or None."""
    label, intents, score, _ = answer
    if label not in LABELS:
        return f"unknown label {label!r}"
    if any(i not in INTENTS for i in intents):
        return f"unknown intent in {intents!r}"
    return None if isinstance(score, int) else f"score {score!r} is no integer"


def answer_misses(misses: DataFrame, classifier: Classifier = offline_classifier, attempts: int = ATTEMPTS, pause_s: float = PAUSE_S) -> DataFrame:
    """body_hash, urgency, intent (JSON), score, reason of misses (row_id, body_hash, body, prompt), one call a distinct hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            left, done = list(range(len(pdf))), {}
            for attempt in range(attempts):
                if not left:
                    break
                if attempt:
                    time.sleep(pause_s * 2 ** (attempt - 1))
                try:
                    answers = dict(zip(left, classifier(pdf.iloc[left])))
                except Exception as e:
                    answers = {}
                    done |= {i: (None, None, None, f"no answer: {e}") for i in left}
                for i, a in answers.items():
                    why = _bad(a)
                    done[i] = (None, None, None, f"refused: {why}") if why else (a[0], json.dumps(a[1]), max(0, min(100, a[2])), a[3])
                left = [i for i in left if done.get(i, (None,))[0] is None]
            frame = pd.DataFrame([done[i] for i in range(len(pdf))], columns=["urgency", "intent", "score", "reason"], index=pdf.index).astype({"score": "Int32"})
            yield pd.concat([pdf[["body_hash"]], frame], axis=1)

    once = misses.groupBy("body_hash").agg(F.min_by(F.struct("body", "prompt"), "row_id").alias("_m")).select("body_hash", "_m.*")
    return once.mapInPandas(run, "body_hash string, urgency string, intent string, score int, reason string")


def classify(messages: DataFrame, answers: DataFrame, classifier: Classifier = offline_classifier, shots: DataFrame | None = None, model: str | None = None, prompt_version: str | None = None, pause_s: float = PAUSE_S) -> DataFrame:
    """Each message, first of its id, with its final answer, from the cache or fresh.

    row_id, message_id, body_hash, urgency, intent, score, reason, rule_hits (JSON), llm_urgency, model, prompt_version,
    from_cache. ``shots`` (body_hash, shots) are the retrieved examples, where there are any. ``model`` and
    ``prompt_version`` restrict the cache to answers of theirs; fresh answers are stored under them.
    """
    extra = [F.col(c) if c in messages.columns else F.lit(None).cast("string").alias(c) for c in ("channel", "received_at")]
    m = store.keep_first(messages.select("row_id", "message_id", "body", *extra), "message_id", "row_id").withColumn("body_hash", body_hash(F.col("body")))
    known = [F.col(c) if c in answers.columns else F.lit(None).cast("string").alias(c) for c in ("intent", "model", "prompt_version")]
    cached = answers.select("body_hash", plain_label(F.coalesce("llm_urgency", "urgency")).alias("urgency"), F.col("score").cast("int").alias("score"), "reason", *known)
    for name, value in (("model", model), ("prompt_version", prompt_version)):
        cached = cached if value is None else cached.where(F.col(name) == value)
    misses = m.where("body IS NOT NULL").join(cached.select("body_hash"), "body_hash", "left_anti")
    if shots is not None:
        misses = misses.join(shots, "body_hash", "left")
    given = F.col("shots") if shots is not None else F.lit(None).cast("array<struct<label:string,body:string>>")
    fresh = answer_misses(misses.withColumn("prompt", prompt(given, F.col("channel"), F.col("received_at"), F.col("body"))), classifier, pause_s=pause_s)
    fresh = fresh.withColumns({"model": F.lit(model or OFFLINE), "prompt_version": F.lit(prompt_version or PROMPT_VERSION), "from_cache": F.lit(False)})
    out = m.join(cached.withColumn("from_cache", F.lit(True)).unionByName(fresh), "body_hash", "left").withColumn("hits", rules.hits(F.col("body")))
    final = rules.floor_label(F.col("hits"), F.col("urgency"))
    score = F.when(F.col("body").isNotNull(), rules.score_if_raised(F.col("score"), F.col("urgency"), final))
    reason = rules.reason(F.col("reason"), F.col("hits"), F.col("urgency") != final)
    return out.select("row_id", "message_id", "body_hash", final.alias("urgency"), "intent", score.alias("score"), reason.alias("reason"), F.to_json("hits").alias("rule_hits"), F.col("urgency").alias("llm_urgency"), "model", "prompt_version", "from_cache")


def to_store(classified: DataFrame) -> DataFrame:
    """The fresh answers as rows of the classifications table, one a hash: that of the lowest row_id."""
    fresh = classified.where("NOT from_cache AND llm_urgency IS NOT NULL")
    columns = ["body_hash", "urgency", "intent", "score", "reason", "rule_hits", "llm_urgency", "model", "prompt_version"]
    return store.keep_first(fresh.select("row_id", *columns), "body_hash", "row_id").select(*columns)


def quarantined(classified: DataFrame) -> DataFrame:
    """Messages whose answer was refused, with the reason."""
    return classified.where("NOT from_cache AND llm_urgency IS NULL").select("row_id", "message_id", "body_hash", "reason")
