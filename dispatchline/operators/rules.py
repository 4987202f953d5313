"""Pattern rules that can only raise a label: rules are data, evaluated as plain expressions in one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import FLAGS, label_of, rank

# Name, label, pattern of each rule, in the order in which hits are reported.
RULES = [
    ("gas_smell", "emergency", r"sme+l+\w*.{0,25}\bga+(s+|z)\b|\bga+(s+|z)\b.{0,25}(sme+l+|leak|escap)"),
    ("carbon_monoxide", "emergency", r"carbon monoxide|\bco (alarm|detector)"),
    ("flood_burst", "emergency", r"flood|burst (pipe|tank|main)|(pouring|gushing) (out|through|down)|water .{0,20}through the ceiling"),
    ("fire_electric", "emergency", r"sparks|burning smell|smell of burning"),
    ("vulnerable_occupant", "same_day", r"\b(baby|newborn|toddler|elderly|disabled|oxygen|pregnant|wheelchair|\d{2}\s?(year|yr)s?[ -]old)\b|\b(mum|mother|dad|father|gran|nan|grandma|grandad)\b.{0,30}\b(8\d|9\d|10\d)\b"),
]
# No heat or hot water; the name and label of a vulnerable occupant without it; the least score of a label.
NO_SERVICE = r"no heating|no hot water|heating (is )?(off|not working)|boiler.{0,20}locked? out|house is freezing|no heat\b"
COMPOUND = ("vulnerable_no_service", "emergency")
SCORE_FLOOR = {"same_day": 40, "emergency": 80}


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(text, F.lit(FLAGS + pattern)), F.lit(False))


def hits(text: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """Names of the rules that match, in rule order, the compound rule last."""
    rules = RULES if rules is None else rules
    each = [F.when(matches(text, p), F.lit(n)) for n, _, p in rules]
    if any(n == "vulnerable_occupant" for n, *_ in rules):
        p = next(p for n, _, p in rules if n == "vulnerable_occupant")
        each.append(F.when(matches(text, p) & matches(text, NO_SERVICE), F.lit(COMPOUND[0])))
    return F.array_compact(F.array(*each))


def floor_label(hit_names: Column, label: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """The higher of a label and the labels of the rules hit; null for an unknown label."""
    levels = [(n, x) for n, x, _ in (RULES if rules is None else rules)] + [COMPOUND]
    raised = [F.when(F.array_contains(hit_names, n), rank(F.lit(x))).otherwise(F.lit(0)) for n, x in levels]
    return F.when(rank(label).isNotNull(), label_of(F.greatest(rank(label), *raised)))


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score.cast("int")))


def score_floor(label: Column) -> Column:
    return F.when(label == "emergency", SCORE_FLOOR["emergency"]).when(label == "same_day", SCORE_FLOOR["same_day"]).otherwise(0)


def score_if_raised(score: Column, label: Column, floored: Column) -> Column:
    """The score, lifted to the floor of its label only where a rule raised the label."""
    return F.when(label != floored, F.greatest(clamped(score), score_floor(floored))).otherwise(clamped(score))


def score_of_probability(p_routine: Column, floored: Column) -> Column:
    """100 times the probability of any urgency, half-even, never below the floor of the final label."""
    return F.greatest(F.bround(F.lit(100) * (1 - p_routine)).cast("int"), score_floor(floored))


def reason(text: Column, hit_names: Column, when: Column) -> Column:
    """The reason with the rules that were hit, where ``when`` holds."""
    return F.when(when & (F.size(hit_names) > 0), F.concat(text, F.lit(" [safety rule: "), F.array_join(hit_names, ", "), F.lit("]"))).otherwise(text)
