"""Windows by state against bulk windows, over files in several splits."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofold.operators import windows
from echofold.sources.store import Collection
from echofold.streaming.ingest import ingest_settled

START = dt.datetime(2024, 1, 1)


def rows_of(n=160):
    rng = np.random.default_rng(4)
    return [(s, START + dt.timedelta(minutes=i), float("nan") if s == "b" and i == 70 else float(np.round(rng.normal(), 3))) for s in "ab" for i in range(n if s == "a" else n - 30)]


@pytest.mark.parametrize("split", ["by time", "interleaved", "one file"])
def test_windows_by_state_are_those_of_bulk(spark, tmp_path, split):
    """Rows are late by up to 20 minutes; a last row of a far time lets the watermark pass all."""
    rows = rows_of()
    sorted_rows = sorted(rows, key=lambda r: r[1])
    if split == "interleaved":
        rng = np.random.default_rng(6)
        sorted_rows = [r for _, r in sorted(((r[1] + dt.timedelta(minutes=float(rng.uniform(0, 15))), r) for r in sorted_rows), key=lambda x: x[0])]
    size = len(sorted_rows) if split == "one file" else 45
    parts = [sorted_rows[i : i + size] for i in range(0, len(sorted_rows), size)] + [[("end", START + dt.timedelta(days=9), 0.0)], [("end", START + dt.timedelta(days=9, minutes=1), 0.0)]]
    schema = "source string, ts timestamp_ntz, value double"
    c = Collection(spark, f"{tmp_path}/points", 24)
    c.create()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i % 3 == 0 or i == len(parts) - 1:  # several starts go on from the kept state
            ingest_settled(spark, f"{tmp_path}/in", c, 24, 6, f"{tmp_path}/state", "20 minutes", 1).awaitTermination()
    expected = windows.sliding_windows(spark.createDataFrame(rows, schema), 24, 6).collect()
    told = lambda rs: sorted((r.source, r.window_idx, r.label_ts, r.last_ts, tuple(r.history_x), tuple(r.future_y)) for r in rs)
    assert told(c.read().where("source <> 'end'").collect()) == told(expected)
    state = spark.read.format("statestore").load(f"{tmp_path}/state").select("key.*", "value.*")
    kept = [c for c in state.columns if c.lower().startswith("groupstate")]
    sizes = state.select(F.size(F.col(f"{kept[0]}.times")) if kept else F.size("times")).collect()
    assert all(r[0] <= 29 + 2 for r in sizes)
