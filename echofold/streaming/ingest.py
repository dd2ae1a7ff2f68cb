"""Windows of growing series, by state kept per source or by reading a source again.

ingest_settled() keeps, for each source, the rows that windows still to come reach back into,
and those that are younger than the watermark and may yet be joined by late ones. A batch
reads its own rows only. ingest_stream() reads the sources that a batch touches in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import encode
from ..plans.forecasting import ingest
from ..schema import SERIES
from ..sources.store import Collection

#: What is kept of a source: the times (micros) and values of the rows kept, and the place of the first of them.
_STATE = "times array<bigint>, values array<double>, first bigint"
_WINDOW = "source string, window_idx bigint, label_ts timestamp_ntz, last_ts timestamp_ntz, history_x array<double>, future_y array<double>"


def _settled(history: int, future: int):
    """The state's step for a source: rows up to the watermark are placed for good and give windows; later ones wait."""
    span = history + future

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, first = state.get if state.exists else ([], [], 0)
        told = [b for b in batches]
        new = pd.concat(told) if told else pd.DataFrame({"micros": [], "value": []})
        new = new[new["micros"].notna()]
        t = np.concatenate([np.array(times, np.int64), new["micros"].to_numpy(np.int64)])
        v = np.concatenate([np.array(values, float), new["value"].to_numpy(float)])
        order = np.lexsort((v, t))  # as windows.positions() places them: by time, then by value
        t, v = t[order], v[order]
        sure = int(np.searchsorted(t, state.getCurrentWatermarkMs() * 1000, "left"))
        n = max(0, sure - span + 1)
        whole = [i for i in range(n) if not np.isnan(v[i : i + span]).any()]
        if n:
            t_keep, v_keep, first_keep = t[n:], v[n:], first + n
        else:
            t_keep, v_keep, first_keep = t, v, first
        state.update((t_keep.tolist(), v_keep.tolist(), int(first_keep)))
        if len(t_keep):  # woken when the watermark has passed all that waits
            state.setTimeoutTimestamp(max(int(t_keep[-1] // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if whole:
            stamp = lambda i: pd.Timestamp(int(t[i]), unit="us")
            yield pd.DataFrame({
                "source": [key[0]] * len(whole), "window_idx": [first + i for i in whole], "label_ts": [stamp(i + history) for i in whole], "last_ts": [stamp(i + span - 1) for i in whole],
                "history_x": [v[i : i + history] for i in whole], "future_y": [v[i + history : i + span] for i in whole],
            })

    return step


def settled_windows(stream: DataFrame, history: int, future: int, late: str) -> DataFrame:
    """The windows of a stream of (source, ts, value) rows whose last row is older than the watermark.

    late: how long a row may come after younger ones; what comes later still is dropped. A
    source's state is its last history + future - 1 settled rows and those that came within
    late, whatever its length.
    """
    rows = stream.where("source is not null").withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    rows = rows.select("source", "time", F.unix_micros("time").alias("micros"), "value")
    return rows.groupBy("source").applyInPandasWithState(_settled(history, future), _WINDOW, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def ingest_settled(spark: SparkSession, folder: str, collection: Collection, history: int, future: int, checkpoint: str, late: str = "1 hour", files: int | None = None) -> StreamingQuery:
    """Each batch of files of (source, ts, value) rows adds the windows that it settles; rows of a source that are already settled are never read again.

    files: how many files make a batch. A repeated batch replaces its own windows.
    """
    reader = spark.readStream.schema(SERIES)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)

    def upsert(batch: DataFrame, _: int) -> None:
        collection.upsert(encode.encoded(batch))

    found = settled_windows(stream, history, future, late)
    return found.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(spark: SparkSession, folder: str, collection: Collection, history: int, future: int, checkpoint: str) -> StreamingQuery:
    """Each new file of (source, ts, value) rows adds or replaces the windows of its sources.

    A file's sources are read again in full, as the windows at its start reach back into
    earlier files; the keyed upsert makes repeated batches harmless. For rows that may come
    late by any time; where that has a bound, ingest_settled() reads each row once.
    """
    def upsert(batch: DataFrame, _: int) -> None:
        touched = batch.select("source").distinct()
        ingest(collection, spark.read.schema(SERIES).parquet(folder).join(touched, "source", "left_semi"), history, future)

    return spark.readStream.schema(SERIES).parquet(folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
