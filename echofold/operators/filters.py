"""Payload filters as JSON: must, should and must_not lists of conditions, compiled into a predicate.

A condition on a missing (null) payload value never holds, so must_not keeps such rows.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_, or_
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The payload keys that filters may name, with the kinds of values they are compared with.
TYPES = {"month": int, "hour": int, "is_weekend": bool, "time_of_day": str, "source": str, "mu": (int, float), "sigma": (int, float)}
KEYS = tuple(TYPES)
_RANGE = {"gte": Column.__ge__, "gt": Column.__gt__, "lt": Column.__lt__, "lte": Column.__le__}
LISTS = ("must", "should", "must_not")


def empty() -> dict[str, list]:
    return {k: [] for k in LISTS}


def is_active(spec: dict[str, list] | None) -> bool:
    return bool(spec) and any(spec.get(k) for k in LISTS)


def _checked(key: str, value: Any) -> Any:
    """The value, if it is of the key's kind: true is no number, and 7 is no text."""
    kind = TYPES.get(key)
    if kind and (not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool)):
        raise ValueError(f"{value!r} is no value of {key}")
    return value


def condition(c: dict[str, Any], keys: tuple[str, ...] = KEYS) -> Column:
    """What the condition says; null or false for a missing value. Left bare, so that it can reach the scan."""
    if (key := c.get("key")) not in keys:
        raise ValueError(f"unknown filter key {key!r}")
    col = F.col(key)
    if "match" in c:
        wanted = [_checked(key, v) for v in (c["match"]["any"] if "any" in c["match"] else [c["match"]["value"]])]
        return col.isin(wanted) if wanted else F.lit(False)
    if "range" in c:
        if unknown := set(c["range"]) - set(_RANGE):
            raise ValueError(f"unknown bounds {sorted(unknown)}")
        return reduce(and_, (_RANGE[op](col, _checked(key, v)) for op, v in c["range"].items()), col.isNotNull())
    raise ValueError(f"a condition needs match or range: {c}")


def compile_filter(spec: dict[str, list] | None, keys: tuple[str, ...] = KEYS) -> Column:
    """All of must, one of should if there are any, none of must_not; null counts as false."""
    spec = spec or {}
    must, should, must_not = ([condition(c, keys) for c in spec.get(k) or []] for k in LISTS)
    out = reduce(and_, must, F.lit(True))
    if should:
        out &= reduce(or_, should)
    return reduce(and_, (~F.coalesce(c, F.lit(False)) for c in must_not), out)


def _holds(points: pa.StructArray, c: dict[str, Any], keys: tuple[str, ...]) -> np.ndarray:
    """Which points a condition holds for, as condition() says it: never for a missing value; not-a-number is above all."""
    if (key := c.get("key")) not in keys:
        raise ValueError(f"unknown filter key {key!r}")
    value = points.field(key)
    if "match" in c:
        wanted = [_checked(key, v) for v in (c["match"]["any"] if "any" in c["match"] else [c["match"]["value"]])]
        one = [pc.equal(value, pa.scalar(w)) for w in wanted]
        return np.asarray(pc.fill_null(reduce(pc.or_, one), False)) if one else np.zeros(len(points), bool)
    if "range" in c:
        if unknown := set(c["range"]) - set(_RANGE):
            raise ValueError(f"unknown bounds {sorted(unknown)}")
        out = np.asarray(pc.is_valid(value)).copy()
        for op, v in c["range"].items():
            found = {"gte": pc.greater_equal, "gt": pc.greater, "lt": pc.less, "lte": pc.less_equal}[op](value, pa.scalar(_checked(key, v)))
            if pa.types.is_floating(value.type) and op in ("gte", "gt"):
                found = pc.or_(found, pc.is_nan(value))
            out &= np.asarray(pc.fill_null(found, False))
        return out
    raise ValueError(f"a condition needs match or range: {c}")


def passing(points: pa.StructArray, specs: list[str | None], keys: tuple[str, ...] = KEYS) -> np.ndarray:
    """Which points (rows) pass each query's filter (columns), given as JSON; no filter lets all pass.

    Each different condition of all filters is tested once for each point, as a bit; a filter
    is a mask of these bits for must and must_not, and another for should.
    """
    different = sorted(set(specs), key=str)
    parsed = [json.loads(s) if s else {} for s in different]
    told = lambda c: json.dumps(c, sort_keys=True)
    conditions = {told(c): c for p in parsed for name in LISTS for c in p.get(name) or []}
    place = {name: i for i, name in enumerate(conditions)}
    bits = np.zeros((len(points), max(len(place), 1)), np.float32)
    for name, i in place.items():
        bits[:, i] = _holds(points, conditions[name], keys)
    must, should, must_not = (np.zeros((len(parsed), bits.shape[1]), np.float32) for _ in LISTS)
    for row, p in enumerate(parsed):
        for mask, name in ((must, "must"), (should, "should"), (must_not, "must_not")):
            for c in p.get(name) or []:
                mask[row, place[told(c)]] = 1
    good = ((1 - bits) @ must.T == 0) & (bits @ must_not.T == 0) & ((bits @ should.T > 0) | (should.sum(1) == 0)[None])
    at = {s: i for i, s in enumerate(different)}
    return good[:, [at[s] for s in specs]]


def repair(answer: str) -> dict[str, list]:
    """The filter object in a model's answer: fences and text around it are dropped, missing lists added."""
    text = re.sub(r"```\w*", "", answer).strip()
    candidates = [text, text[text.find("{") : text.rfind("}") + 1]] if "{" in text else [text]
    for part in candidates:
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return empty() | found
    raise ValueError("the answer holds no JSON object")
