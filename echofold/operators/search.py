"""Exact nearest neighbours by cosine, with payload filters applied before ranking.

Few queries are sent to the points, which stay where they are: each task multiplies its
batches of points with the query vectors as matrices and gives, for each query, only those
that can be among its k best of the task so far. Spark then ranks these few. That holds for
at most QUERY_BYTES of query vectors; more queries meet the points by the metric index of
cells.py, where neither table is sent anywhere whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import filters

#: The most bytes of query vectors that go to the executors.
QUERY_BYTES = 64 << 20
#: Scores that a task holds at once.
TILE = 1 << 21
PLACES = 9


class Block(NamedTuple):
    keys: pa.Array
    vectors: np.ndarray
    before: np.ndarray | None
    specs: list[str | None] | None


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if len(flat) != len(vectors) * width:
        raise ValueError(f"vectors must have {width} dimensions")
    return flat.reshape(len(vectors), width)


def _micros(times: pa.Array) -> np.ndarray:
    """Times as numbers; a missing one is later than all, so that it comes before none."""
    return np.asarray(pc.fill_null(times.cast(pa.int64()), np.iinfo(np.int64).max))


class Best:
    """The k best rounded scores of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.scores = k, np.full((k, queries), -np.inf)

    def take(self, lo: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of scores (points in key order, by queries from lo on): rows and columns of those that may still count."""
        k, held = min(self.k, len(scores)), self.scores[:, lo : lo + scores.shape[1]]
        kth = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        bound = np.maximum(kth, held.min(0))
        better = scores > kth
        even = (scores == kth) & (kth > -np.inf)
        room = k - better.sum(0)
        first = even if (even.sum(0) <= room).all() else even & (np.cumsum(even, axis=0) <= room)
        row, col = np.nonzero((better | first) & (scores >= bound))
        top = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k :]
        both = np.concatenate([held, top])
        held[:] = np.partition(both, len(both) - self.k, axis=0)[len(both) - self.k :]
        return row, col


def candidates(block, points: DataFrame, k: int, query_key: str, key_type: str, keys: list[str], threshold: float | None, exclude: str | None, before: str | None, passing: str | None, fallback: bool) -> DataFrame:
    """For each query of the block the points that can be among its k best, with _pass: of those that pass its filter and, for the fallback, of the others.

    passing: the points' column that tells whether they pass. Filters of the queries' own are in the block.
    """
    given = [c for c in points.columns if c not in ("vector", passing)]
    schema = T.StructType([T.StructField(query_key, T._parse_datatype_string(key_type)), *(points.schema[c] for c in given), T.StructField("score", T.DoubleType()), T.StructField("_rounded", T.DoubleType()), T.StructField("_pass", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = block.value
        best = {flag: Best(len(q.vectors), k) for flag in (True, False)}
        for b in batches:
            table = pa.Table.from_batches([b])
            table = table.filter(pc.is_valid(table["vector"])).sort_by([(c, "ascending") for c in keys]).combine_chunks()
            if not len(table):
                continue
            x = _matrix(table["vector"].combine_chunks(), q.vectors.shape[1])
            times = None if before is None else _micros(table[before].combine_chunks())
            payload = pa.StructArray.from_arrays([table[c].combine_chunks() for c in given], given)
            own = None if passing is None else np.asarray(table[passing].combine_chunks())
            size = max(1, TILE // len(x))
            for lo in range(0, len(q.vectors), size):
                s = x @ q.vectors[lo : lo + size].T
                rounded = np.round(s, PLACES)
                if times is not None:
                    rounded[times[:, None] >= q.before[None, lo : lo + size]] = -np.inf
                if exclude is not None:
                    same = pc.index_in(table[exclude].combine_chunks(), q.keys.slice(lo, size))
                    at = np.flatnonzero(np.asarray(pc.is_valid(same)))
                    rounded[at, np.asarray(same.drop_null())] = -np.inf
                if threshold is not None:
                    rounded[s < threshold] = -np.inf
                good = np.ones(s.shape, bool) if q.specs is None else filters.passing(payload, q.specs[lo : lo + size])
                if own is not None:
                    good &= own[:, None]
                for flag in (True, False) if fallback else (True,):
                    of_flag = np.where(good == flag, rounded, -np.inf)
                    row, col = best[flag].take(lo, of_flag)
                    keep = of_flag[row, col] > -np.inf
                    row, col = row[keep], col[keep]
                    if len(row):
                        taken = payload.take(pa.array(row)).flatten()
                        yield pa.RecordBatch.from_arrays([q.keys.take(pa.array(lo + col)), *taken, pa.array(s[row, col]), pa.array(rounded[row, col]), pa.array(np.full(len(row), flag))], schema.names)

    return points.mapInArrow(run, schema)


def top_k(found: DataFrame, k: int, query_key: str, keys: list[str]) -> DataFrame:
    """The k best of each query with rank_no; equal scores (to 9 places) go by key."""
    w = Window.partitionBy(query_key).orderBy(F.col("_rounded").desc(), *keys)
    return found.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)


def search(queries: DataFrame, points: DataFrame, k: int, query_key: str, keys: list[str], where: Column | None = None, threshold: float | None = None, exclude: str | None = None, before: tuple[str, str] | None = None, fallback: bool = False, spec: str | None = None) -> DataFrame:
    """Hits of each query: the points' columns without vector, the queries' without q_vector, score and rank_no.

    Vectors must be unit vectors; a null one is no point and no query. where filters the
    points; spec is the queries' column of filters of their own, as JSON. exclude: the points'
    column that must differ from the query's key. before: the points' time that must come
    before the queries' time (a missing one does not). fallback: a query without a hit under
    the filters takes its hits without them.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    asked = queries.where("q_vector is not null")
    width = asked.agg(F.count("*").alias("n"), F.max(F.size("q_vector")).alias("width")).first()
    if width["n"] * (width["width"] or 1) * 8 > QUERY_BYTES:
        return _in_cells(queries, points, k, query_key, keys, where, threshold, exclude, before, fallback, spec)
    passing = "_pass" if fallback and where is not None else None
    if passing:
        points = points.withColumn(passing, F.coalesce(where, F.lit(False)))
    elif where is not None:
        points = points.where(where)
    held = asked.select(F.col(query_key), "q_vector", *([F.col(before[1]).alias("_before")] if before else []), *([F.col(spec).alias("_spec")] if spec else [])).toArrow()
    block = Block(held[query_key].combine_chunks(), _matrix(held["q_vector"].combine_chunks(), width["width"] or 1), _micros(held["_before"].combine_chunks()) if before else None, held["_spec"].to_pylist() if spec else None)
    shared = queries.sparkSession.sparkContext.broadcast(block)
    found = candidates(shared, points, k, query_key, dict(queries.dtypes)[query_key], keys, threshold, exclude, before and before[0], passing, fallback)
    if fallback:  # the best k with and without the filter are few rows; which of them count is settled after that
        both = Window.partitionBy(query_key, "_pass").orderBy(F.col("_rounded").desc(), *keys)
        best = found.withColumn("_r", F.row_number().over(both)).where(F.col("_r") <= k)
        best = best.withColumn("_hit", F.max("_pass").over(Window.partitionBy(query_key)))
        found = best.where(F.col("_pass") | ~F.col("_hit")).withColumn("fallback_used", ~F.col("_hit")).drop("_r", "_hit")
    hits = top_k(found.drop("_pass"), k, query_key, keys).drop("_rounded")
    more = [c for c in queries.columns if c not in (query_key, "q_vector")]
    return hits.join(asked.select(query_key, *more), query_key) if more else hits


def _in_cells(queries: DataFrame, points: DataFrame, k: int, query_key: str, keys: list[str], where: Column | None, threshold: float | None, exclude: str | None, before: tuple[str, str] | None, fallback: bool, spec: str | None) -> DataFrame:
    from . import cells

    if where is None:
        return cells.search(queries, cells.build(points, keys), k, query_key, threshold, exclude, before, spec, fallback)
    hits = cells.search(queries, cells.build(points.where(where), keys), k, query_key, threshold, exclude, before, spec)
    if not fallback:
        return hits
    left = queries.join(hits.select(F.col(query_key).alias("_q")).distinct(), F.col(query_key).eqNullSafe(F.col("_q")), "left_anti")
    rest = cells.search(left, cells.build(points, keys), k, query_key, threshold, exclude, before)
    return hits.withColumn("fallback_used", F.lit(False)).unionByName(rest.withColumn("fallback_used", F.lit(True)))
