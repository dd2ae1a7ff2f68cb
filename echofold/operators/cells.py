"""Exact nearest neighbours by a metric index.

Unit vectors are put into cells around centres that are fitted on a bounded sample
(SAMPLE_BYTES); every vector is in the index. Points are dealt out by ranges of cell and
angle to its centre, so that a cell of any size is spread over tasks, and kept in blocks of
rows that share a cell and a range of angles.

A query first meets the nearest cells that hold k points. Its k-th best score there bounds
the rest: by the triangle inequality of angles a block whose angles lie too far from the
query's own angle to the centre can't hold a better one and is never read for it. Queries and
its first blocks meet by a shuffle on cell, packs of queries with blocks of points, as matrices.
The rest meet in a grid: a pack goes to one row's tasks, a block to one column's, so that the
copies of either go with the sides of the grid (GROUPS) and not with the cells that a query
meets; a task passes over blocks out of reach and gives a query's best of all its blocks. A query
with fewer than k hits so far (a filter, a threshold) meets all blocks, so the hits are those
of a full scan. No query or point goes through the driver; the centres and a row for each
cell do, whose number is bounded by CELLS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import discard, stage
from . import filters
from .search import PLACES, Best, _matrix, _micros, top_k

#: The most cells, and bytes of vectors in the sample that they are fitted on.
CELLS, SAMPLE_BYTES = 4_096, 16 << 20
#: Points in a block, queries in a pack, and the fewest cells that a query meets first.
BLOCK, PACK, PROBES = 2_048, 256, 2
#: Angles of queries to cells that a task holds at once, and rows of queries with a cell that it gives at once.
ANGLES, GIVEN = 1 << 20, 1 << 13
#: Groups of blocks and groups of packs at most, and points that a task holds, which adds groups of blocks.
GROUPS, HELD = (8, 12), 1 << 17
#: Rounded scores are kept, and angles are floating: bounds are this much wider.
SLACK = 1e-7
#: The cell of vectors without a direction, which score 0 with all.
NOWHERE = -1


class Index(NamedTuple):
    """blocks: staged rows of cell, lo, hi (angles), n, vectors (one after another) and rows (keys and payload, in key order)."""

    blocks: DataFrame
    centres: np.ndarray
    keys: list[str]

    def discard(self) -> None:
        discard(self.blocks)


def fitted(sample: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    """Centres of a sample of unit vectors: the first different ones, moved to the directions of their members' sums."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(0).permutation(len(centres))[:cells]]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def build(points: DataFrame, keys: list[str], cells: int | None = None) -> Index:
    """The index of the points' unit vectors; a null vector is no point, other columns are payload."""
    payload = [c for c in points.columns if c != "vector"]
    there = points.where("vector is not null")
    size = there.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    n, width = size["n"], size["width"] or 1
    most = max(1, SAMPLE_BYTES // (8 * width))
    draw = there.where(F.pmod(F.xxhash64(*keys), F.lit(max(1, n // most))) == 0).limit(most).select("vector").toArrow()
    sample = _matrix(draw["vector"].combine_chunks(), width) if len(draw) else np.zeros((0, width))
    sample = sample[np.linalg.norm(sample, axis=1) > 0.5]
    wanted = cells or min(CELLS, max(1, int(np.sqrt(n))))
    centres = fitted(sample, wanted) if len(sample) else np.eye(1, width)
    shared = points.sparkSession.sparkContext.broadcast(centres)
    placed_schema = T.StructType([*(points.schema[c] for c in payload), points.schema["vector"], T.StructField("_cell", T.IntegerType()), T.StructField("_angle", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(len(payload)), width)
            cos = x @ shared.value.T
            cell = cos.argmax(1)
            angle = np.arccos(np.clip(cos[np.arange(len(x)), cell], -1, 1)) if len(x) else np.zeros(0)
            none = np.linalg.norm(x, axis=1) < 0.5
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(none, NOWHERE, cell), pa.int32()), pa.array(np.where(none, 0.0, angle))], placed_schema.names)

    placed = stage(there.select(*payload, "vector").mapInArrow(place, placed_schema))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(parts, "_cell", "_angle", *keys).sortWithinPartitions("_cell", "_angle", *keys)
    schema = T.StructType(
        [
            T.StructField("cell", T.IntegerType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("n", T.LongType()),
            T.StructField("vectors", T.ArrayType(T.DoubleType())), T.StructField("rows", T.ArrayType(T.StructType([points.schema[c] for c in payload]))),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "_cell", BLOCK):
            angle = t["_angle"]
            bounds = pc.min_max(angle).as_py()
            t = t.sort_by([(c, "ascending") for c in keys]).combine_chunks()
            rows = pa.StructArray.from_arrays([t[c].combine_chunks() for c in payload], payload)
            vectors = t["vector"].combine_chunks().flatten().cast(pa.float64())
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (vectors, rows)]
            yield pa.RecordBatch.from_arrays([t["_cell"].combine_chunks()[:1], pa.array([bounds["min"]], pa.float64()), pa.array([bounds["max"]], pa.float64()), pa.array([len(t)]), *lists], schema.names)

    blocks = stage(ranged.mapInArrow(pack, schema))
    discard(placed)
    return Index(blocks, centres, keys)


def runs(batches: Iterator[pa.RecordBatch], by: str, most: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of at most so many rows with one value of a column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        value = b.column(b.schema.get_field_index(by)).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(value)) + 1).tolist(), len(value)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(held[0].schema.get_field_index(by))[0].as_py() != value[lo]:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            while lo < hi:
                take = min(hi - lo, most - size)
                held.append(b.slice(lo, take))
                lo, size = lo + take, size + take
                if size == most:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _scores(points: pa.StructArray, x: np.ndarray, keys: pa.Array, q: np.ndarray, when: np.ndarray | None, specs: list[str | None] | None, threshold: float | None, exclude: str | None, before: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores of points (rows) with queries, and the same rounded, without those that are no hits."""
    s = x @ q.T
    rounded = np.round(s, PLACES)
    if before is not None:
        rounded[_micros(points.field(before))[:, None] >= when[None]] = -np.inf
    if exclude is not None:
        at = pc.index_in(points.field(exclude), keys)
        hit = np.flatnonzero(np.asarray(pc.is_valid(at)))
        for p, name in zip(hit, points.field(exclude).take(pa.array(hit)), strict=True):
            rounded[p, np.asarray(pc.fill_null(pc.equal(keys, name), False))] = -np.inf
    if specs is not None:
        rounded[~filters.passing(points, specs)] = -np.inf
    if threshold is not None:
        rounded[s < threshold] = -np.inf
    return s, rounded


def _room(kth: np.ndarray) -> np.ndarray:
    """The angle to a query within which a point must lie to score its k-th best or more."""
    return np.where(np.isneginf(kth), 4.0, np.arccos(np.clip(kth - SLACK, -1, 1)) + SLACK)


def _in_grid(asked: DataFrame, index: Index, k: int, query_key: str, threshold: float | None, exclude: str | None, before: str | None) -> DataFrame:
    """The candidates of queries with their k-th best scores so far (_kth) among all blocks within reach, by a grid of packs and blocks."""
    own = [c for c in asked.columns if c != "_kth"]
    kinds, place = {c: asked.schema[c].dataType for c in own}, {c: i for i, c in enumerate(own)}
    schema = T.StructType([*(T.StructField(f"_{i}", T.ArrayType(kinds[c] if c != "q_vector" else T.DoubleType())) for i, c in enumerate(own)), T.StructField("_kths", T.ArrayType(T.DoubleType()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, PACK):
                b = big.slice(at, PACK)
                flat = [b.column(b.schema.get_field_index(c)) for c in (*own, "_kth")]
                flat = [x.flatten().cast(pa.float64()) if c == "q_vector" else x for c, x in zip((*own, "_kth"), flat, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) for x in flat], schema.names)

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = index.blocks.agg(F.sum("n")).first()[0] or 0
    across = max(min(GROUPS[0], int(np.ceil(np.sqrt(parts / 2)))), -(-n // HELD))
    down = min(GROUPS[1], -(-2 * parts // across))

    def dealt(rows: DataFrame, group: Column, many: int, cell: Callable[[Column, Column], Column]) -> DataFrame:
        copies = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: cell(F.col("_group"), i).cast("int"))
        return rows.withColumn("_group", group).withColumn("_task", F.explode(copies)).drop("_group")

    points = dealt(index.blocks.select(F.lit(0).alias("_kind"), "*"), F.pmod(F.xxhash64("cell", "lo", "hi", F.hash("vectors")), F.lit(across)), down, lambda g, i: g * down + i)
    packs = stage(asked.mapInArrow(pack, schema)).withColumn("_id", F.monotonically_increasing_id())
    packs = dealt(packs, F.pmod(F.xxhash64("_id"), F.lit(down)), across, lambda g, i: i * down + g).drop("_id").withColumn("_kind", F.lit(1))
    columns = ["_kind", "cell", "lo", "hi", "vectors", "rows", *schema.names]
    both = points.unionByName(packs, allowMissingColumns=True).repartitionById(across * down, F.col("_task")).sortWithinPartitions("_kind").select(*columns)
    payload = index.blocks.schema["rows"].dataType.elementType
    out = T.StructType([T.StructField(query_key, kinds[query_key]), *payload.fields, T.StructField("score", T.DoubleType()), T.StructField("_rounded", T.DoubleType())])
    shared = asked.sparkSession.sparkContext.broadcast(index.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                kind, cell, lo, hi, flat, rows, *asks, kths = (b.column(j)[i] for j in range(b.num_columns))
                if kind.as_py() == 0:  # a task's blocks come first
                    held.append((cell.as_py(), lo.as_py(), hi.as_py(), flat.values.to_numpy().reshape(len(rows), -1), rows.values))
                    continue
                keys, kth = asks[place[query_key]].values, kths.values.to_numpy()
                q = asks[place["q_vector"]].values.to_numpy().reshape(len(keys), -1)
                if q.shape[1] != shared.value.shape[1]:
                    raise ValueError(f"vectors must have {shared.value.shape[1]} dimensions")
                when = None if before is None else _micros(asks[place["_before"]].values)
                specs = asks[place["_spec"]].values.to_pylist() if "_spec" in place else None
                angles, room = _angles(q, shared.value), _room(kth)
                room[np.linalg.norm(q, axis=1) < 0.5] = 4.0  # nothing can be left out for a query without a direction
                best = Best(len(keys), k)
                best.scores[:] = kth[None]
                for cell, lo, hi, x, points in held:
                    # points without a direction score 0 with all
                    away = np.full(len(q), np.pi / 2 - SLACK) if cell == NOWHERE else np.maximum(lo - angles[:, cell], angles[:, cell] - hi)
                    near = np.flatnonzero(away <= room)
                    if not len(near):
                        continue
                    names = keys.take(pa.array(near))
                    s, rounded = _scores(points, x, names, q[near], None if when is None else when[near], None if specs is None else [specs[j] for j in near], threshold, exclude, before)
                    some = Best(len(near), k)
                    some.scores = best.scores[:, near]
                    row, col = some.take(0, rounded)
                    best.scores[:, near] = some.scores
                    good = rounded[row, col] > -np.inf
                    row, col = row[good], col[good]
                    if len(row):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(col)), *points.take(pa.array(row)).flatten(), pa.array(s[row, col]), pa.array(rounded[row, col])], out.names)

    return both.mapInArrow(run, out)


def _meet(asked: DataFrame, index: Index, k: int, query_key: str, threshold: float | None, exclude: str | None, before: str | None) -> DataFrame:
    """The candidates of (query, cell) rows: packs of queries that share a cell, joined with its blocks within reach.

    asked: query_key, q_vector, _before, _spec, _cell, _angle (to the cell's centre), _reach (the angle within which a hit must lie).
    """
    spark = asked.sparkSession
    own = [c for c in asked.columns if c not in ("_cell", "_angle", "_reach")]
    kinds = {c: asked.schema[c].dataType for c in own}
    schema = T.StructType([T.StructField("_cell", T.IntegerType()), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType()), *(T.StructField(f"_{i}", T.ArrayType(kinds[c] if c != "q_vector" else T.DoubleType())) for i, c in enumerate(own)), T.StructField("_angles", T.ArrayType(T.DoubleType())), T.StructField("_reaches", T.ArrayType(T.DoubleType()))])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = asked.repartition(parts, "_cell", F.pmod(F.xxhash64(query_key), F.lit(16))).sortWithinPartitions("_cell", "_angle")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "_cell", PACK):
            angle, reach = (t[c].combine_chunks().to_numpy() for c in ("_angle", "_reach"))
            flat = [t[c].combine_chunks() if c != "q_vector" else t[c].combine_chunks().flatten().cast(pa.float64()) for c in own]
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (*flat, pa.array(angle), pa.array(reach))]
            yield pa.RecordBatch.from_arrays([t["_cell"].combine_chunks()[:1], pa.array([(angle - reach).min()]), pa.array([(angle + reach).max()]), *lists], schema.names)

    packed = salted.mapInArrow(pack, schema)
    pairs = packed.join(index.blocks, (F.col("_cell") == F.col("cell")) & (F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("_lo")))
    payload = index.blocks.schema["rows"].dataType.elementType
    out = T.StructType([T.StructField(query_key, kinds[query_key]), *payload.fields, T.StructField("score", T.DoubleType()), T.StructField("_rounded", T.DoubleType())])
    place = {c: i for i, c in enumerate(own)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lo, hi, flat, rows, *asks, angles, reaches = (b.column(j)[i] for j in range(b.num_columns))
                angle, reach = (x.values.to_numpy() for x in (angles, reaches))
                near = np.flatnonzero((lo.as_py() <= angle + reach) & (hi.as_py() >= angle - reach))
                if not len(near):
                    continue
                points, keys = rows.values, asks[place[query_key]].values
                x = flat.values.to_numpy().reshape(len(points), -1)
                q = asks[place["q_vector"]].values.to_numpy().reshape(len(keys), -1)[near]
                if x.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors must have {x.shape[1]} dimensions")
                keys = keys.take(pa.array(near))
                when = None if before is None else _micros(asks[place["_before"]].values)[near]
                specs = [asks[place["_spec"]].values[j].as_py() for j in near.tolist()] if "_spec" in place else None
                s, rounded = _scores(points, x, keys, q, when, specs, threshold, exclude, before)
                row, col = Best(len(near), k).take(0, rounded)
                good = rounded[row, col] > -np.inf
                row, col = row[good], col[good]
                if len(row):
                    taken = points.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(col)), *taken.flatten(), pa.array(s[row, col]), pa.array(rounded[row, col])], out.names)

    slim = pairs.select("lo", "hi", "vectors", "rows", *[f"_{i}" for i in range(len(own))], "_angles", "_reaches")
    return slim.mapInArrow(run, out)


def _toward(asked: DataFrame, index: Index, first: bool, k: int, seen: dict[int, tuple[int, float, float]]) -> DataFrame:
    """asked with a row for each cell to meet: the nearest that hold k points, or all others that the k-th score _kth leaves."""
    schema = T.StructType([*(f for f in asked.schema if f.name != "_kth"), T.StructField("_cell", T.IntegerType()), T.StructField("_angle", T.DoubleType()), T.StructField("_reach", T.DoubleType())])
    cells = np.array(sorted(seen), np.int64)
    n, lo, hi = (np.array([seen[c][i] for c in cells]) for i in range(3))
    towards = np.array([index.centres[c] if c >= 0 else np.zeros(index.centres.shape[1]) for c in cells]).reshape(len(cells), -1)
    shared = asked.sparkSession.sparkContext.broadcast((cells, n, lo, hi, towards))
    names = [f.name for f in asked.schema if f.name != "_kth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n, lo, hi, towards = shared.value
        some = max(1, ANGLES // max(1, len(cells)))
        for big in batches:
            for at in range(0, big.num_rows, some):
                b = big.slice(at, some)
                q = _matrix(b.column(b.schema.get_field_index("q_vector")), towards.shape[1])
                angle = _angles(q, towards)
                away = np.maximum(np.maximum(lo[None] - angle, angle - hi[None]), 0.0)
                none = np.linalg.norm(q, axis=1) < 0.5
                away[:, cells == NOWHERE] = np.pi / 2 - SLACK  # these score 0 with all
                away[none] = 0.0  # as does a query without a direction: nothing can be left out for it
                order = np.lexsort((np.broadcast_to(cells, away.shape), away), axis=1)
                held = np.cumsum(n[order], axis=1)
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(len(cells))[None].repeat(len(q), 0), 1)
                enough = (held < k).sum(1) + 1
                early = rank < np.maximum(enough, min(PROBES, len(cells)))[:, None]
                if first:
                    row, col = np.nonzero(early)
                    reach = np.full(len(row), 4.0)
                else:
                    kth = b.column(b.schema.get_field_index("_kth")).to_numpy()
                    room = _room(kth)
                    room[none] = 4.0
                    row, col = np.nonzero(~early & (away <= room[:, None]))
                    reach = room[row]
                # a cell without a direction has angles of 0: what is kept of it is always within reach
                at_angle = np.where(cells[col] == NOWHERE, 0.0, angle[row, col])
                reach = np.where(none[row], 4.0, reach)
                for given in range(0, len(row), GIVEN):  # a query may meet all cells, and has its vector in each of these rows
                    part = slice(given, given + GIVEN)
                    rows = [b.column(b.schema.get_field_index(c)).take(pa.array(row[part])) for c in names]
                    yield pa.RecordBatch.from_arrays([*rows, pa.array(cells[col[part]], pa.int32()), pa.array(at_angle[part]), pa.array(reach[part])], schema.names)

    return asked.mapInArrow(run, schema)


def found(queries: DataFrame, index: Index, k: int, query_key: str, threshold: float | None = None, exclude: str | None = None, before: tuple[str, str] | None = None, spec: str | None = None, count: bool = False) -> tuple[DataFrame, float | None]:
    """The hits (query_key, keys and payload, score, rank_no), and if asked for, the share of (query, block) pairs whose cells met.

    spec: the queries' column of payload filters as JSON. The rest as in search().
    """
    if k < 1:
        raise ValueError("k is at least 1")
    asked = queries.where("q_vector is not null").select(query_key, "q_vector", *([F.col(before[1]).alias("_before")] if before else []), *([F.col(spec).alias("_spec")] if spec else []))
    asked = stage(asked.withColumn("_query", F.monotonically_increasing_id()))
    time = before[0] if before else None
    seen = {r["cell"]: (r["n"], r["lo"], r["hi"]) for r in index.blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}  # at most CELLS + 1 rows
    if not seen:
        rows = T.StructType([queries.schema[query_key], *index.blocks.schema["rows"].dataType.elementType.fields, T.StructField("score", T.DoubleType()), T.StructField("rank_no", T.IntegerType())])
        return queries.sparkSession.createDataFrame([], rows), 0.0 if count else None
    nearest = stage(_toward(asked, index, True, k, seen))
    early = stage(top_k(_meet(nearest.drop("_query"), index, k, query_key, threshold, exclude, time), k, query_key, index.keys))
    reached = early.groupBy(query_key).agg(F.count("*").alias("_n"), F.min("_rounded").alias("_low")).withColumnRenamed(query_key, "_q")
    bounded = asked.join(reached, F.col(query_key).eqNullSafe(F.col("_q")), "left").withColumn("_kth", F.when(F.col("_n") >= k, F.col("_low")).otherwise(F.lit(float("-inf"))))
    bounded = stage(bounded.select(*asked.columns, "_kth"))
    # the early hits are within reach too, and are found again
    best = stage(top_k(_in_grid(bounded.drop("_query"), index, k, query_key, threshold, exclude, time), k, query_key, index.keys).drop("_rounded"))
    share = None
    if count:  # a row for each cell at most
        blocks = {r["cell"]: r["n"] for r in index.blocks.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        later = _toward(bounded, index, False, k, seen)
        met = {r["_cell"]: r["n"] for r in nearest.select("_cell").unionByName(later.select("_cell")).groupBy("_cell").agg(F.count("*").alias("n")).collect()}
        share = sum(n * blocks[c] for c, n in met.items()) / max(1, asked.count() * sum(blocks.values()))
    discard(asked, nearest, early, bounded)
    return best, share


def search(queries: DataFrame, index: Index, k: int, query_key: str, threshold: float | None = None, exclude: str | None = None, before: tuple[str, str] | None = None, spec: str | None = None, fallback: bool = False) -> DataFrame:
    """search() over an index: hits with the queries' other columns; spec filters query by query.

    fallback: a query without a hit under its filter takes its hits without it, told by fallback_used.
    """
    hits, _ = found(queries, index, k, query_key, threshold, exclude, before, spec)
    if fallback:
        left = queries.join(hits.select(F.col(query_key).alias("_q")).distinct(), F.col(query_key).eqNullSafe(F.col("_q")), "left_anti")
        rest, _ = found(left, index, k, query_key, threshold, exclude, before)
        hits = hits.withColumn("fallback_used", F.lit(False)).unionByName(rest.withColumn("fallback_used", F.lit(True)))
    more = [c for c in queries.columns if c not in (query_key, "q_vector")]
    return hits.join(queries.where("q_vector is not null").select(query_key, *more), query_key) if more else hits
