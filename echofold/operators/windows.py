"""Sliding (history, future) windows over long series.

A window frame over a whole series would put it into one task. So rows are dealt out by
ranges of source and time first and get their place from counts: those of the earlier ranges
of their source and their own rank in their range. A range is about a task's share of all
rows, however densely a source's rows lie in time. Blocks of consecutive places, each with
copies of the rows that its last windows reach into, are then gathered as arrays of a bounded
length; windows are cut from these, all of them or only those that are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import let
from ..schema import SIGMA_FLOOR
from ..sources.staging import stage

#: Windows that start in one block.
BLOCK = 4_000
#: Counts of so many ranges and sources are broadcast; more are joined by a shuffle.
COUNTS = 200_000
#: A window's columns besides its keys.
WINDOW = ("label_ts", "last_ts", "history_x", "future_y")
#: Windows that are cut at once.
CUT = 1_000


def positions(series: DataFrame, tie: str | None = None) -> DataFrame:
    """series with window_idx, the 0-based place of a row by time in its source. A row without a time has no place and goes.

    Equal times go by tie, then by value. The ranged rows are staged, as ranges are drawn anew whenever they are computed.
    """
    order = ["source", "ts", *([tie] if tie else []), "value"]
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = series.where("ts is not null and source is not null").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = stage(rows.withColumn("_id", F.monotonically_increasing_id()))  # the partition in the upper 31 bits, the row's rank in the lower 33
    part = F.shiftright("_id", 33)
    counts = held.groupBy("source", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(counts.select("source", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    offsets = F.broadcast(offsets) if offsets.count() <= COUNTS else offsets
    return held.withColumn("_part", part).join(offsets, ["source", "_part"]).withColumn("window_idx", F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def _dealt(series: DataFrame, span: int, tie: str | None, block: int) -> DataFrame:
    """The rows of each block of block places and of the span - 1 places behind it, by source and _block."""
    placed = positions(series, tie).select("source", "ts", "value", "window_idx")
    own = F.floor(F.col("window_idx") / block)
    reach = -(-(span - 1) // block)
    blocks = F.sequence(F.greatest(own - reach, F.lit(0)), own)
    return placed.withColumn("_block", F.explode(blocks)).where(F.col("window_idx") < (F.col("_block") + 1) * block + span - 1)


def series_blocks(series: DataFrame, history: int, future: int, tie: str | None = None, block: int = BLOCK) -> DataFrame:
    """The series themselves, in blocks from which windows can be cut and searched: source, block, first, size, ts and values.

    first is the place of the block's first row; windows start at its first size places. Each
    value is held once, but for the history + future - 1 rows that two blocks share.
    """
    rows = _dealt(series, history + future, tie, block)
    held = rows.groupBy("source", "_block").agg(F.array_sort(F.collect_list(F.struct("window_idx", "ts", "value"))).alias("_rows"))
    return held.select(
        "source", F.col("_block").alias("block"), (F.col("_block") * block).alias("first"), F.greatest(F.least(F.size("_rows") - (history + future - 1), F.lit(block)), F.lit(0)).alias("size"),
        F.transform("_rows", lambda r: r["ts"]).alias("ts"), F.transform("_rows", lambda r: r["value"]).alias("values"),
    )


def _cut(blocks: DataFrame, starts: Column, history: int, future: int, columns: tuple[str, ...]) -> DataFrame:
    """The keys and columns of windows at the given 0-based places within each block, those with a missing value left out.

    Columns are those of a window, and mu and sigma (floored) of its history. In Python, as Spark's slice() copies a block's array as objects for each window that is cut from it.
    """
    span = history + future
    kind, numbers = blocks.schema["ts"].dataType.elementType, T.ArrayType(T.DoubleType())
    kinds = {"label_ts": kind, "last_ts": kind, "history_x": numbers, "future_y": numbers, "mu": T.DoubleType(), "sigma": T.DoubleType()}
    names = {"source": T.StringType(), "window_idx": T.LongType()} | {c: kinds[c] for c in columns}

    def lists(values: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
        cut = np.lib.stride_tricks.sliding_window_view(values, size)[at]
        return pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * size, cut.ravel())

    def column(name: str, stamps: pa.Array, values: np.ndarray, at: np.ndarray) -> pa.Array:
        if name in ("label_ts", "last_ts"):
            return stamps.take(pa.array(at + (history if name == "label_ts" else span - 1)))
        if name in ("history_x", "future_y"):
            return lists(values, at, history) if name == "history_x" else lists(values[history:], at, future)
        held = np.lib.stride_tricks.sliding_window_view(values, history)[at]
        if name == "mu":
            return pa.array(held.mean(1))
        sigma = held.std(1)
        return pa.array(np.where(sigma < SIGMA_FLOOR, 1.0, sigma))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                source, first, stamps, values, at = (b.column(i)[row] for i in range(5))
                values, at = values.values.to_numpy(zero_copy_only=False).astype(float, copy=False), at.values.to_numpy()
                gaps = np.concatenate([[0], np.cumsum(np.isnan(values))])  # a null is one, too
                at = at[gaps[at + span] == gaps[at]]
                for lo in range(0, len(at), CUT):
                    own = at[lo : lo + CUT]
                    cols = [pa.repeat(source, len(own)), pa.array(first.as_py() + own.astype(np.int64)), *(column(c, stamps.values, values, own) for c in columns)]
                    yield pa.RecordBatch.from_arrays(cols, list(names))

    return blocks.select("source", "first", "ts", "values", starts.alias("_starts")).mapInArrow(run, T.StructType([T.StructField(k, v) for k, v in names.items()]))


def every_window(blocks: DataFrame, n: int, history: int, future: int, columns: tuple[str, ...] = WINDOW) -> DataFrame:
    """The windows whose window_idx is divisible by n: their keys and these columns."""
    ahead = F.pmod(-F.col("first"), F.lit(n)).cast("int")
    starts = F.when(ahead < F.col("size"), F.sequence(ahead, F.col("size") - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
    return _cut(blocks, starts, history, future, columns)


def wanted_windows(blocks: DataFrame, wanted: DataFrame, history: int, future: int, block: int = BLOCK, *, columns: tuple[str, ...] = WINDOW) -> DataFrame:
    """The windows at the wanted (source, window_idx), once each, however often they are wanted.

    A block comes together with the list of its wanted places, which is no longer than the block.
    """
    own = F.floor(F.col("window_idx") / block).alias("block")
    lists = wanted.select("source", own, "window_idx").distinct().groupBy("source", "block").agg(F.collect_list("window_idx").alias("_wanted"))
    both = blocks.join(lists, ["source", "block"])
    starts = F.filter(F.transform("_wanted", lambda i: (i - F.col("first")).cast("int")), lambda i: i < F.col("size"))
    return _cut(both, starts, history, future, columns)


def sliding_windows(series: DataFrame, history: int, future: int, tie: str | None = None, block: int = BLOCK, complete: bool = True) -> DataFrame:
    """source, window_idx, label_ts (first future row), last_ts, history_x and future_y at stride 1.

    complete drops windows with a missing value (null or not a number).
    """
    span = history + future
    rows = _dealt(series, span, tie, block)
    # windows are some hundred times their rows: the rows are dealt out by blocks into a fixed number of parts, not merged into a few by their own size
    rows = rows.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "_block")
    missing = (F.col("value").isNull() | F.isnan("value")).cast("int")
    upto = Window.partitionBy("source", "_block").orderBy("window_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("source", "_block", F.struct("window_idx", "ts", "value", missing.alias("gap"), F.sum(missing).over(upto).alias("gaps")).alias("_row"))
    held = rows.groupBy("source", "_block").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))

    def cut(b: Column) -> Column:
        def window(i: Column) -> Column:
            first, last = F.get(b["rows"], i), F.get(b["rows"], i + (span - 1))
            return F.struct(
                first["window_idx"].alias("window_idx"), F.get(b["rows"], i + history)["ts"].alias("label_ts"), last["ts"].alias("last_ts"),
                F.slice(b["values"], i + 1, history).alias("history_x"), F.slice(b["values"], i + (history + 1), future).alias("future_y"),
                (last["gaps"] - first["gaps"] + first["gap"]).alias("missing"),
            )

        starts = F.least(F.size(b["rows"]) - span + 1, F.lit(block))
        return F.transform(F.when(starts > 0, F.sequence(F.lit(0), starts - 1)).otherwise(F.array().cast("array<int>")), window)

    values = F.transform("_rows", lambda r: r["value"])
    found = held.select("source", F.inline(let(F.struct(F.col("_rows").alias("rows"), values.alias("values")), cut)))
    return (found.where("missing = 0") if complete else found).drop("missing")


def sample_windows(windows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n windows without replacement: those with the smallest digests of seed and key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "source", F.col("window_idx").cast("string")))
    return windows.orderBy(digest, "source", "window_idx").limit(n)


def batches(rows: DataFrame, size: int, place: str = "window_idx") -> DataFrame:
    """rows with batch_no: consecutive slices of each source by place, so that a place left out leaves its slice shorter."""
    return rows.withColumn("batch_no", F.floor(F.col(place) / size))


def preview(windows: DataFrame, n: int = 3) -> DataFrame:
    """The first n windows of each source with the extremes of their arrays."""
    first = windows.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("window_idx"))).where(F.col("_r") <= n)
    return first.select("source", "window_idx", "label_ts", *[f(c).alias(f"{k}_{c}") for c in ("history_x", "future_y") for k, f in (("min", F.array_min), ("max", F.array_max))])
