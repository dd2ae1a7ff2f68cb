"""Settings and table schemas of the forecasting engine."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import types as T


@dataclass(frozen=True)
class Config:
    history: int = 100
    future: int = 48
    top_k: int = 5
    agent_top_k: int = 10
    encoder_length: int = 512
    encoder_width: int = 320
    seed: int = 42
    most_k: int = 100

    def to_json(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))


#: The settings that the engine's ends start from.
DEFAULTS = Config()

#: Below these a deviation or norm counts as none; guards of the weight and ratio denominators.
SIGMA_FLOOR = 1e-10
NORM_FLOOR = 1e-10
IDW_EPS = 1e-10
RATIO_EPS = 1e-6

SERIES = T.StructType([T.StructField("source", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType())])

#: A stored window. The time columns are null for samples that come without a timestamp.
POINT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("window_idx", T.LongType()),
        T.StructField("label_ts", T.TimestampNTZType()),
        T.StructField("last_ts", T.TimestampNTZType()),
        T.StructField("history_x", T.ArrayType(T.DoubleType())),
        T.StructField("future_y", T.ArrayType(T.DoubleType())),
        T.StructField("mu", T.DoubleType()),
        T.StructField("sigma", T.DoubleType()),
        T.StructField("vector", T.ArrayType(T.DoubleType())),
        T.StructField("month", T.IntegerType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("is_weekend", T.BooleanType()),
        T.StructField("time_of_day", T.StringType()),
    ]
)
