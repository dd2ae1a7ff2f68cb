"""Phrases of a question to a payload filter, by rules; a language model can be plugged in."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .filters import empty, repair

_SUMMER = {"key": "month", "range": {"gte": 6, "lt": 9}}
#: Phrases, in lower case, and the conditions they stand for.
RULES: tuple[tuple[tuple[str, ...], tuple[dict, ...]], ...] = (
    (("weekend", "周末"), ({"key": "is_weekend", "match": {"value": True}},)),
    (("workday", "weekday", "工作日"), ({"key": "is_weekend", "match": {"value": False}},)),
    (("july", "七月", "7月"), ({"key": "month", "match": {"value": 7}},)),
    (("summer", "夏季", "夏天"), (_SUMMER,)),
    (("peak", "高峰"), ({"key": "time_of_day", "match": {"value": "evening"}}, _SUMMER)),
    (("late night", "深夜", "凌晨"), ({"key": "time_of_day", "match": {"value": "night"}},)),
)


def parse_intent(question: str, sources: tuple[str, ...] = (), model: Callable[[str], str] | None = None) -> dict[str, list]:
    """The filter a question asks for. Blank: no condition. sources: names of series it may mention."""
    found = empty()
    if not question.strip():
        return found
    if model is not None:
        return repair(model(question))
    low = question.lower()
    for phrases, conditions in RULES:
        if any(p in low for p in phrases):
            found["must"] += [c for c in conditions if c not in found["must"]]
    found["must"] += [{"key": "source", "match": {"value": s}} for s in sources if s.lower() in low.replace(",", " ").split()]
    return found


def filters_of(question: Column | str, sources: tuple[str, ...] = ()) -> Column:
    """parse_intent() by the rules, for a column of questions: the filters as JSON, null for a question that asks for no condition."""
    low = F.lower(question)
    words = F.split(F.regexp_replace(low, ",", " "), r"\s+")
    asked = [(reduce(or_, (F.contains(low, F.lit(p)) for p in phrases)), conditions) for phrases, conditions in RULES]
    asked += [(F.array_contains(words, s.lower()), ({"key": "source", "match": {"value": s}},)) for s in sources]
    none = F.array().cast("array<string>")
    lists = [F.when(F.coalesce(said, F.lit(False)), F.array(*(F.lit(json.dumps(c)) for c in conditions))).otherwise(none) for said, conditions in asked]
    must = F.array_distinct(F.concat(*lists))
    return F.when(F.size(must) > 0, F.concat(F.lit('{"must": ['), F.array_join(must, ", "), F.lit('], "should": [], "must_not": []}')))


def status_message(k: Column, filtered: Column, n: Column) -> Column:
    found = F.format_string("top %d %s filter: %d hits", k, F.when(filtered, "with").otherwise("without"), n)
    return F.when(n > 0, found).otherwise(F.lit("no similar window was found; the forecast is the mean of the history"))
