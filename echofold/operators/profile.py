"""Nearest windows straight from the series, without windows or vectors stored.

A unit vector of a z-scored history is the history less its mean over its length, so the
score of a query with a window is one product of the query's vector with the series, divided
by the window's deviation. The products of a pack of queries with all windows of a block are
a matrix product in single precision with the block's overlapping windows or, for long histories,
a product of Fourier transforms; means and deviations come from prefix sums. Windows that may be
among a query's best by these figures, given how far they may be off, and windows that are too
quiet for prefix sums to be exact, are then scored again from their own values, so that the hits
are those of the stored vectors. Only queries whose best score in a block reaches their k-th so
far are looked at there; one whose k hits all have the highest score there is, to the places
that count, is done, as equal scores go to the earlier window.
Queries may have payload filters of their own, tested on the windows' payload as it is cut: each
different filter once a block, and queries whose filter lets none of its windows pass are left out.

Packs and blocks are dealt into the cells of a grid: a pack goes to one row's cells, a block to
one column's, so that each meets each in one cell and the copies of either go with the side of
the grid, which is bounded (GROUPS). A pack holds its queries' histories, if there are any, in the
order of their places, and not their vectors: those of neighbours hold the same values, which
compress, and a task makes unit vectors of them. A cell is a task: it holds its column's blocks (HELD rows
of series at most, which adds columns for longer series) and takes packs as they come. Blocks
that begin too late for a query are left out. A task gives a query's k best of its blocks and
no more. Long series are searched some columns of the grid at a time, whose copies go before
the next ones come. Nothing goes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import NORM_FLOOR, SIGMA_FLOOR
from ..sources.staging import discard, stage
from . import filters
from .search import PLACES, top_k

#: Queries that go together.
PACK = 256
#: Histories from this length on are multiplied as Fourier transforms.
FOURIER = 400
#: Windows whose deviation is below this share of their block's are scored from their own values alone.
QUIET = 1e-4
#: How far fast scores in double precision may be off; in single precision a history's length times its rounding comes on top.
SLACK, SINGLE = 1e-7, 2.0**-24
#: Windows whose products with a pack are made at once, and pairs that are scored again at once.
TILE, AGAIN = 500, 20_000
#: Groups of blocks and groups of packs at most, and rows of series that a task holds.
GROUPS, HELD = (8, 12), 1 << 23
#: Rows of series from which on columns of the grid are searched one part after another, and parts at most.
PART, PARTS = 1 << 17, 4


def packs(queries: DataFrame, key: str, before: str | None, spec: str | None = None, pack: int = PACK) -> DataFrame:
    """Rows of at most pack queries: keys, their histories (vectors, if they have none) one after another, their times, the latest of these, and their filters."""
    kind, time = queries.schema[key].dataType, F.lit(None).cast("timestamp_ntz") if before is None else F.col(before)
    clock = T.TimestampNTZType() if before is None else queries.schema[before].dataType
    schema = T.StructType([T.StructField("keys", T.ArrayType(kind)), T.StructField("vectors", T.ArrayType(T.DoubleType())), T.StructField("before", T.ArrayType(clock)), T.StructField("latest", clock), T.StructField("specs", T.ArrayType(T.StringType()))])
    if "q_history_x" not in queries.columns:
        held = F.col("q_vector")
    elif "q_vector" in queries.columns:  # a vector that isn't the history's own is told by its length, and refused by the search
        held = F.when(F.size("q_vector") == F.size("q_history_x"), F.col("q_history_x")).otherwise(F.col("q_vector"))
    else:
        held = F.col("q_history_x")
    places = [c for c in ("q_source", "q_window_idx") if c in queries.columns]
    slim = queries.where(held.isNotNull()).select(*places, F.col(key).alias("key"), held.alias("held"), time.alias("time"), (F.col(spec) if spec else F.lit(None)).cast("string").alias("spec"))
    if before is not None:  # queries of about the same time go together, so that late blocks are left out for whole packs; without a time there is no hit
        slim = slim.where("time is not null").repartitionByRange(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "time").sortWithinPartitions(*places, "time")
    slim = slim.drop(*places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            times = t["time"].combine_chunks()
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (t["key"].combine_chunks(), t["held"].combine_chunks().flatten(), times)]
            specs = t["spec"].combine_chunks()
            return pa.RecordBatch.from_arrays([*lists, pa.array([pc.max(times)], times.type), pa.ListArray.from_arrays([0, len(specs)], specs)], schema.names)

        for b in batches:
            while b.num_rows:
                take = min(pack - sum(x.num_rows for x in held), b.num_rows)
                held.append(b.slice(0, take))
                b = b.slice(take)
                if sum(x.num_rows for x in held) == pack:
                    yield told()
                    held.clear()
        if held:
            yield told()

    return slim.mapInArrow(run, schema)


def _numbers(times: pa.ListScalar) -> np.ndarray:
    return times.values.cast(pa.int64()).to_numpy()


def unit(windows: np.ndarray) -> np.ndarray:
    """Unit vectors of z-scored histories (rows), zeros where there is next to no deviation."""
    away = windows - windows.mean(1, keepdims=True)
    sigma = np.sqrt((away * away).mean(1, keepdims=True))
    z = away / np.where(sigma < SIGMA_FLOOR, 1.0, sigma)
    norm = np.sqrt((z * z).sum(1, keepdims=True))
    return np.where(norm > NORM_FLOOR, z / np.where(norm > NORM_FLOOR, norm, 1.0), 0.0)


class Stretch:
    """A block's values, ready for products: its windows' deviations, and which windows are whole."""

    def __init__(self, values: np.ndarray, size: int, history: int, span: int) -> None:
        gap = np.isnan(values)
        self.values, self.size, self.history = np.where(gap, 0.0, values), size, history
        gaps = np.concatenate([[0], np.cumsum(gap)])
        self.whole = gaps[span : span + size] == gaps[:size]
        centred = np.where(gap, 0.0, values - (np.nanmean(values) if not gap.all() else 0.0))
        self.centred = centred
        one, two = (np.concatenate([[0.0], np.cumsum(x)]) for x in (centred, centred * centred))
        mean = (one[history : history + size] - one[:size]) / history
        deviation = np.sqrt(np.maximum((two[history : history + size] - two[:size]) / history - mean * mean, 0))
        self.quiet = self.whole & ~(deviation > QUIET * max(np.sqrt(two[-1] / max(len(values), 1)), SIGMA_FLOOR))
        self.length = np.where(self.quiet | ~self.whole, 1.0, deviation * np.sqrt(history))
        self._scaled: np.ndarray | None = None
        self._passing: dict[str | None, np.ndarray] = {}

    def windows(self, at: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.values, self.history)[at]

    def payload(self, source: str, times: pa.Array, future: int) -> pa.StructArray:
        """The payload of all windows, as encode.encoded() gives it; times are the rows'."""
        label = times.slice(self.history, self.size)
        hour = pc.hour(label)
        quarter = pa.array(["night", "morning", "afternoon", "evening"]).take(pc.divide(hour, 6))
        held = np.lib.stride_tricks.sliding_window_view(self.values, self.history)[: self.size]
        sigma = held.std(1)
        cols = {
            "source": pa.array([source] * self.size, pa.string()), "month": pc.month(label), "hour": hour, "is_weekend": pc.greater_equal(pc.day_of_week(label), 5), "time_of_day": quarter,
            "mu": pa.array(held.mean(1)), "sigma": pa.array(np.where(sigma < SIGMA_FLOOR, 1.0, sigma)),
        }
        return pa.StructArray.from_arrays(list(cols.values()), list(cols))

    def scaled(self) -> np.ndarray:
        """The windows' unit vectors in single precision; zeros for a window with an infinite value, which then isn't whole."""
        if self._scaled is None:  # once for all packs
            away = np.lib.stride_tricks.sliding_window_view(self.centred, self.history)[: self.size]
            away = away - away.mean(1, keepdims=True)  # windows far from their block's mean would lose their places in single precision
            held = (away / np.sqrt(np.where(self.quiet, 1.0, np.einsum("ij,ij->i", away, away)))[:, None]).astype(np.float32)
            if self.quiet.any():
                held[self.quiet] = unit(self.windows(np.flatnonzero(self.quiet)))
            if (endless := ~np.isfinite(held).all(1)).any():
                held[endless], self.whole = 0, self.whole & ~endless
            self._scaled = held
        return self._scaled

    def transformed(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """Scores of the queries (rows) with the first n windows, by Fourier transforms."""
        points = 1 << (len(self.centred) + self.history - 1).bit_length()
        both = np.fft.rfft(self.centred, points) * np.fft.rfft(vectors[:, ::-1], points)
        out = np.fft.irfft(both, points)[:, self.history - 1 : self.history - 1 + n] / self.length[:n]
        at = np.flatnonzero(self.quiet[:n])
        out[:, at] = vectors @ unit(self.windows(at)).T
        return np.where(np.isnan(out), -np.inf, out)

    def scores(self, vectors: np.ndarray, fourier: int, n: int) -> Iterator[tuple[int, np.ndarray, float]]:
        """Fast scores of the queries (rows) with the first n windows, some windows at a time: the first of these, their scores, whole or not, and how far these may be off."""
        if self.history >= fourier:
            yield 0, self.transformed(vectors, n), SLACK
            return
        held, single = self.scaled(), vectors.astype(np.float32)
        for lo in range(0, n, TILE):
            yield lo, single @ held[lo : min(lo + TILE, n)].T, SLACK + (self.history + 4) * SINGLE

    def passing(self, specs: list[str | None], source: str, times: pa.Array, future: int) -> np.ndarray:
        """Which windows (columns) pass each filter; one that was tested before is not tested again."""
        if new := [x for x in specs if x not in self._passing]:
            payload = self.payload(source, times, future)
            self._passing.update(zip(new, filters.passing(payload, new).T, strict=True))
        return np.stack([self._passing[x] for x in specs])


def best(stretch: Stretch, vectors: np.ndarray, open_: np.ndarray, k: int, least: np.ndarray, fourier: int, passing: np.ndarray | None = None, spec: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, window and exact score of the windows of a block that may be among each query's k best.

    open_: how many windows from the first on a query may have. least: scores below which a query's
    hits don't count. passing: which windows (columns) pass each filter; spec: each query's filter among these.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    asks = open_ > 0
    if passing is not None:
        asks &= np.where(passing.any(1), passing.argmax(1), stretch.size)[spec] < open_
    if not asks.any():
        return none
    at = np.flatnonzero(asks)
    n, bar = int(open_[at].max()), least[at]
    found = []
    for lo, s, off in stretch.scores(vectors if asks.all() else vectors[at], fourier, n):
        low = np.maximum(bar - off, -2.0).astype(s.dtype)
        low = np.nextafter(low, s.dtype.type(-np.inf))  # where single precision has rounded it up
        rows = np.flatnonzero(s.max(1) >= low)
        if not len(rows):
            continue
        s, asked, width = s[rows], at[rows], s.shape[1]
        good = s >= low[rows, None]
        if not stretch.whole[lo : lo + width].all():
            good &= stretch.whole[lo : lo + width]
        if int(open_[asked].min()) < lo + width:
            good &= np.arange(lo, lo + width) < open_[asked, None]
        if passing is not None:
            good &= passing[spec[asked], lo : lo + width]
        many = np.flatnonzero(np.count_nonzero(good, axis=1) > 4 * k)  # what these have found so far leaves too many
        if len(many):
            kth = np.partition(np.where(good[many], s[many], -np.inf), width - k, axis=1)[:, width - k]
            good[many] &= s[many] >= (kth - 2 * off)[:, None]
            bar[rows[many]] = np.maximum(bar[rows[many]], kth - off)
        row, window = np.divmod(np.flatnonzero(good), width)
        found.append((asked[row], lo + window))
    if not found:
        return none
    query, window = (np.concatenate(x) for x in zip(*found, strict=True))
    score = np.empty(len(window))
    for lo in range(0, len(window), AGAIN):
        own, where = np.unique(window[lo : lo + AGAIN], return_inverse=True)
        score[lo : lo + AGAIN] = np.einsum("ij,ij->i", unit(stretch.windows(own))[where], vectors[query[lo : lo + AGAIN]])
    return query, window, score


class Leaders:
    """The k best windows of each query of a pack so far; equal scores (to 9 places) go by place, if blocks come in the order of their places."""

    def __init__(self, vectors: np.ndarray, k: int, threshold: float | None) -> None:
        self.k, self.threshold = k, threshold
        self.least = np.full(len(vectors), -np.inf if threshold is None else threshold)
        self.most = vectors.any(1).astype(float)  # the highest score there can be
        self.full = np.zeros(len(vectors), bool)
        self.query, self.block, self.window = (np.zeros(0, np.int64) for _ in range(3))
        self.score = np.zeros(0)

    @property
    def done(self) -> np.ndarray:
        """Queries that no later window can be a hit of."""
        return self.full & (np.round(self.least, PLACES) >= self.most)

    def take(self, block: int, query: np.ndarray, window: np.ndarray, score: np.ndarray) -> None:
        good = ~self.full[query] | (np.round(score, PLACES) > np.round(self.least[query], PLACES))  # equal ones are later
        if self.threshold is not None:
            good &= score >= self.threshold
        if not good.any():
            return
        query, window, score = (np.r_[x, y[good]] for x, y in ((self.query, query), (self.window, window), (self.score, score)))
        block = np.r_[self.block, np.full(len(query) - len(self.block), block)]
        order = np.lexsort((window, block, -np.round(score, PLACES), query))
        query = query[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1])
        rank = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
        order = order[rank < self.k]
        self.query, self.block, self.window, self.score = query[rank < self.k], block[order], window[order], score[order]
        self.full = np.bincount(self.query, minlength=len(self.least)) == self.k
        worst = np.full(len(self.least), np.inf)
        np.minimum.at(worst, self.query, self.score)
        self.least = np.where(self.full, np.maximum(self.least, worst), self.least)


def nearest(queries: DataFrame, blocks: DataFrame, k: int, history: int, future: int, key: str = "q_key", before: str | None = "q_label_ts", threshold: float | None = None, spec: str | None = None, fourier: int = FOURIER) -> DataFrame:
    """key, source, window_idx, score and rank_no of each query's k nearest windows, staged.

    queries have q_history_x, a history of this length, or q_vector, its unit vector z-scored. blocks are a
    staged series_blocks(). before: the queries' time that a hit's last row must come before; a
    query without one has no hit. A query's own windows are hits like any other. spec: the
    queries' column of payload filters as JSON.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    spark, kind = queries.sparkSession, queries.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("source", T.StringType()), T.StructField("window_idx", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("_rounded", T.DoubleType())])
    span, bare = history + future, "q_history_x" in queries.columns
    there = blocks.where("size > 0")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = there.agg(F.sum("size")).first()[0] or 0
    across = max(min(GROUPS[0], math.ceil(math.sqrt(parts / 2))), -(-rows // HELD))
    down = min(GROUPS[1], -(-2 * parts // across))

    def dealt(rows: DataFrame, fixed: Column, step: int, n: int) -> DataFrame:
        """A copy of the rows for each of n cells from a fixed one on."""
        return rows.withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (fixed + i * step).cast("int"))))

    own = there.select(
        F.lit(0).alias("_kind"), "source", "first", "size", "values", F.col("ts").alias("times"),
        F.pmod(F.xxhash64("source") % across + F.col("block"), F.lit(across)).alias("_group"),
    )
    made = F.monotonically_increasing_id()  # a part's packs, and the first packs of parts, which are in order of time, go in turns: later packs meet more blocks
    packed = stage(packs(queries, key, before, spec).withColumn("_group", F.pmod(F.shiftright(made, 33) + made.bitwiseAND((1 << 33) - 1), F.lit(down))))
    asked = packed.select(F.lit(1).alias("_kind"), "keys", "vectors", "before", "specs", "_group")
    columns = ["_kind", "source", "first", "size", "values", "times", "keys", "vectors", "before", "specs"]
    def cells(lo: int, hi: int) -> DataFrame:
        """The grid's columns from lo to hi - 1."""
        mine = own.where(F.col("_group").between(lo, hi - 1)).withColumn("_group", F.col("_group") - lo)
        both = dealt(mine, F.col("_group") * down, 1, down).unionByName(dealt(asked, F.col("_group"), down, hi - lo), allowMissingColumns=True)
        return both.repartitionById((hi - lo) * down, F.col("_cell")).sortWithinPartitions("_kind", "source", "first").select(*columns)

    def answers(held: list[tuple], asks: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The hits of packs among the blocks that the task holds."""
        leaders = [Leaders(vectors, k, threshold) for _, vectors, *_ in asks]
        for at, (source, _, size, values, stamps) in enumerate(held):
            stretch, ends = None, None if before is None else stamps.cast(pa.int64()).to_numpy()[span - 1 : span - 1 + size]
            for (_, vectors, times, specs, own), found in zip(asks, leaders, strict=True):
                open_ = np.full(len(vectors), size) if before is None else np.searchsorted(ends, times, "left")
                open_[found.done] = 0
                if not open_.any():
                    continue
                if stretch is None:
                    stretch = Stretch(values.to_numpy(zero_copy_only=False).astype(float), size, history, span)
                good = None if spec is None else stretch.passing(specs, source, stamps, future)
                found.take(at, *best(stretch, vectors, open_, k, found.least, fourier, good, own))
        for (keys, *_), found in zip(asks, leaders, strict=True):
            if len(found.query):
                sources = pa.array([x[0] for x in held], pa.string()).take(pa.array(found.block))
                firsts = np.array([x[1] for x in held], np.int64)[found.block]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(found.query)), sources, pa.array(firsts + found.window), pa.array(found.score), pa.array(np.round(found.score, PLACES))], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            asks = []
            for row, kind in enumerate(b.column(0).to_pylist()):
                source, first, size, values, stamps, keys, flat, times, specs = (b.column(i)[row] for i in range(1, 10))
                if kind == 0:  # a task's blocks come first, in the order of their places
                    held.append((source.as_py(), first.as_py(), size.as_py(), values.values, stamps.values))
                    continue
                vectors = flat.values.to_numpy().reshape(len(keys), -1)
                if vectors.shape[1] != history:
                    raise ValueError(f"vectors must have {history} dimensions")
                different = specs.values.dictionary_encode("encode")  # a missing filter is one, too
                asks.append((keys.values, unit(vectors) if bare else vectors, None if before is None else _numbers(times), different.dictionary.to_pylist(), different.indices.to_numpy()))
            yield from answers(held, asks)

    turns = max(1, min(PARTS, across, rows // PART))
    edges = [across * i // turns for i in range(turns + 1)]
    found = [stage(top_k(cells(lo, hi).mapInArrow(run, schema), k, key, ["source", "window_idx"])) for lo, hi in zip(edges, edges[1:], strict=False)]
    discard(packed)
    if turns == 1:
        return found[0].drop("_rounded")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    out = stage(top_k(every.drop("rank_no"), k, key, ["source", "window_idx"]).drop("_rounded"))
    discard(*found)
    return out
