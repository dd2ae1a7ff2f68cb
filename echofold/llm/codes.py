"""Product codes of vectors by Lloyd's rounds with Hamerly's bounds.

A vector's components become integers and its parts are coded one by one by the nearest
entry of the part position's codebook. The rows carry, for each part, the entry, an upper
bound of the distance to it and a lower bound of the distance to the second nearest. After
an update the bounds move by the entries' drifts. Where the upper bound stays strictly below
the lower one (or below half the way to the entry's nearest neighbour) the entry is the one
nearest and nothing is computed; elsewhere the upper bound is made exact first, and if that
does not help, all entries are scanned in integers, the lower index winning ties. Bounds are
rounded outward, so that they hold whatever the precision they are kept in.

Each round is a staged table; of the rows, tasks give sums per part and entry only, so what
reaches the driver is the codebooks, whatever the number of vectors.

Defined results: a null vector and one with a null or non-finite component are dropped. A
null vec_id is coded like any other and comes after all ids in the choice of first entries; a
repeated vec_id gives a row each. Null labels are one label. Fewer vectors than entries make
a smaller codebook; an empty table gives no rows. Vectors of several lengths, of one that the
parts don't divide, or with a component of 2^19 or more are an error. Columns other than
vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, small_batches, stage

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Integer components stay below this, so that distances and a batch's sums are exact.
LIMIT = 1 << 27
#: Label sums of up to so many labels are broadcast; more are joined by a shuffle.
LABELS = 100_000


class Books(NamedTuple):
    """Codebooks (part, entry, position), how far each entry moved, and half the way to its nearest neighbour."""

    entries: np.ndarray
    drift: np.ndarray
    half: np.ndarray


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def books(entries: np.ndarray, before: np.ndarray | None = None) -> Books:
    move = np.zeros(entries.shape[:2]) if before is None else above(np.sqrt(((entries - before) ** 2).sum(2)))
    way = ((entries[:, :, None] - entries[:, None]) ** 2).sum(3).astype(float)
    way[:, np.arange(entries.shape[1]), np.arange(entries.shape[1])] = np.inf
    return Books(entries, move, below(below(np.sqrt(way.min(2, initial=np.inf))) / 2))


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row, the squared distance to it and the second smallest one."""
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    at = d.argmin(1)
    rows = np.arange(len(x))
    least = d[rows, at]
    if len(entries) == 1:
        return at, least, np.full(len(x), -1)
    d[rows, at] = np.iinfo(np.int64).max
    return at, least, d.min(1)


def _lower(second: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances whose squares are given; -1: there is no second entry."""
    return np.where(second < 0, np.inf, below(np.sqrt(np.maximum(second, 0))))


def reassign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, drift: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries and bounds of one part's rows after the codebook has moved, and how many rows were scanned in full."""
    order = np.argsort(drift)
    rest = np.where(code == order[-1], drift[order[-2]] if len(order) > 1 else 0.0, drift[order[-1]])  # the most that another entry moved
    upper, lower = above(upper + drift[code]), below(lower - rest)
    bound = np.maximum(lower, half[code])
    open_ = np.flatnonzero(~(upper < bound))
    upper[open_] = above(np.sqrt(((x[open_] - entries[code[open_]]) ** 2).sum(1)))
    open_ = open_[~(upper[open_] < bound[open_])]
    if len(open_):
        at, least, second = scan(x[open_], entries)
        code[open_], upper[open_], lower[open_] = at, above(np.sqrt(least)), _lower(second)
    return code, upper, lower, len(open_)


def _kept32(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nextafter(upper.astype(np.float32), np.float32(np.inf)), np.nextafter(lower.astype(np.float32), np.float32(-np.inf))


def _rows(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as an array of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(values.reshape(-1), kind))


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    lists = column(b, name)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % max(len(lists), 1) or (np.diff(lists.offsets.to_numpy()) * len(lists) != len(flat)).any():
        raise ValueError("vectors must have one length")
    return flat.reshape(len(lists), -1)


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and the integer components v of the vectors that count."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where("embedding is not null").where(~odd)
    return kept.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def first_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids, ascending; equal ids by their vectors."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    v = [r["v"] for r in first]
    width = len(v[0]) if v else parts
    if not width or width % parts or any(len(x) != width for x in v):
        raise ValueError(f"vectors must have one length that {parts} divides")
    return np.array(v, np.int64).reshape(len(v), parts, width // parts).transpose(1, 0, 2)


def assign(rows: DataFrame, book: Books, last: bool) -> DataFrame:
    """rows with code, upper and lower; from rows that have none by full scans, from others by their bounds.

    last: vec_id, label, code as hex digits, and error instead. n_scans has how many parts of a row's were scanned.
    """
    ids, new = rows.select("vec_id", "label").schema, "code" not in rows.columns
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ids)
    schema = f"{own}, {'code string, error bigint' if last else 'v array<bigint>, code array<int>, upper array<float>, lower array<float>'}, n_scans int"
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, drift, half = shared.value
        parts, _, width = entries.shape
        for b in small_batches(batches, 2048):
            if not b.num_rows:
                continue
            v = _matrix(b, "v")
            if v.shape[1] != parts * width or (np.abs(v) >= LIMIT).any():
                raise ValueError(f"vectors must have {parts * width} components below 2^19")
            x, scans = v.reshape(-1, parts, width), np.zeros(len(v), np.int32)
            code, upper, lower = np.zeros((len(v), parts), np.int64), np.zeros((len(v), parts)), np.zeros((len(v), parts))
            if not new:
                code, upper, lower = _matrix(b, "code").astype(np.int64), _matrix(b, "upper").astype(float), _matrix(b, "lower").astype(float)
            for p in range(parts):
                if new:
                    at, least, second = scan(x[:, p], entries[p])
                    code[:, p], upper[:, p], lower[:, p] = at, above(np.sqrt(least)), _lower(second)
                    scans += 1
                else:
                    was = lower[:, p].copy()
                    code[:, p], upper[:, p], lower[:, p], _ = reassign(x[:, p], code[:, p], upper[:, p], lower[:, p], entries[p], drift[p], half[p])
                    scans += lower[:, p] > was  # only a full scan raises a lower bound; others leave or lower it
            same = [column(b, "vec_id"), column(b, "label")]
            if last:
                chosen = entries[np.arange(parts)[None], code]
                told = [pa.array([bytes(r).hex() for r in code.astype(np.uint8)], pa.string()), pa.array(((x - chosen) ** 2).sum((1, 2)))]
                names = ["code", "error"]
            else:
                up, low = _kept32(upper, lower)
                told = [column(b, "v"), _rows(code, pa.int32()), _rows(up, pa.float32()), _rows(low, pa.float32())]
                names = ["v", "code", "upper", "lower"]
            yield pa.RecordBatch.from_arrays([*same, *told, pa.array(scans)], ["vec_id", "label", *names, "n_scans"])

    return rows.mapInArrow(run, schema)


def updated(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The codebooks with each used entry at the floor of its parts' mean."""
    parts, size, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for b in small_batches(batches, 8192):
            if not b.num_rows:
                continue
            x, code = _matrix(b, "v").reshape(-1, parts, width), _matrix(b, "code")
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=size)
                for w in range(width):  # sums of a batch are below 2^53 and so exact
                    sums[p, :, w] += np.bincount(code[:, p], weights=x[:, p, w], minlength=size).astype(np.int64)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), *(pa.array(sums[part, entry, w]) for w in range(width))], ["part", "entry", "n", *(f"s{w}" for w in range(width))])

    names = [f"s{w}" for w in range(width)]
    each = rows.select("v", "code").mapInArrow(run, "part bigint, entry bigint, n bigint, " + ", ".join(f"{s} bigint" for s in names))
    out = entries.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect():  # at most parts x entries rows
        out[r["part"], r["entry"]] = [r[s] // r["n"] for s in names]
    return out


def told(entries: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error, n_scans (of the last assignment) of each vector, staged, and the codebooks (part, entry, position)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits has 1 to 256 entries")
    rows = integers(vectors.select("vec_id", "embedding", "label"))
    book = books(first_entries(rows, parts, entries))
    if not book.entries.size:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).alias("n_scans")).limit(0), book.entries
    for _ in range(rounds):
        state = stage(assign(rows, book, last=False))
        if hasattr(rows, "staged_at"):
            discard(rows)
        rows, book = state, books(updated(state, book.entries), book.entries)
    out = stage(assign(rows, book, last=True))
    if hasattr(rows, "staged_at"):
        discard(rows)
    return out, book.entries


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors summed over equal labels; nulls are one label."""
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    sums = F.broadcast(sums) if sums.count() <= LABELS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
