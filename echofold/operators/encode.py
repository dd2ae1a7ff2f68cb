"""Encoders: from a window's history to a unit vector."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.timefeat import time_features
from ..schema import DEFAULTS, NORM_FLOOR


class Encoder(Protocol):
    def encode(self, windows: DataFrame) -> DataFrame:
        """windows (with z) and their vector."""


class ZScoreEncoder:
    """The normalised z-scored history itself; cosines are then correlations of histories."""

    def encode(self, windows: DataFrame) -> DataFrame:
        return windows.withColumn("vector", V.l2("z"))


@dataclass(frozen=True)
class ProjectionEncoder:
    """A seeded random projection of the z-scored history onto width dimensions."""

    length: int
    width: int = DEFAULTS.encoder_width
    seed: int = DEFAULTS.seed

    def encode(self, windows: DataFrame) -> DataFrame:
        rows = np.random.default_rng(self.seed).standard_normal((self.width, self.length)) / np.sqrt(self.width)
        matrix = F.array(*(F.array(*map(F.lit, r)) for r in rows.tolist()))
        return windows.withColumn("vector", V.let(F.col("z"), lambda z: V.l2(F.transform(matrix, lambda r: V.dot(r, z)))))


@dataclass(frozen=True)
class OnnxEncoder:
    """A sequence model in ONNX: zeros at the head up to length, run, mean over time, unit length."""

    path: str
    length: int = DEFAULTS.encoder_length
    width: int = DEFAULTS.encoder_width

    def encode(self, windows: DataFrame) -> DataFrame:
        path, length, width = self.path, self.length, self.width

        @F.pandas_udf("array<double>")
        def run(z: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import onnxruntime

            session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
            name = session.get_inputs()[0].name
            if np.shape(session.run(None, {name: np.zeros((1, length, 1), np.float32)})[0]) != (1, length, width):
                raise ValueError(f"the model does not give (1, {length}, {width})")
            for part in z:
                out = []
                for x in part:
                    tail = np.asarray(x, np.float32)[-length:]
                    padded = np.r_[np.zeros(length - len(tail), np.float32), tail].reshape(1, length, 1)
                    v = session.run(None, {name: padded})[0][0].mean(0).astype(float)
                    n = np.linalg.norm(v)
                    out.append((v / n if n > 1e-10 else v * 0).tolist())
                yield pd.Series(out)

        return windows.withColumn("vector", run("z"))


@dataclass(frozen=True)
class LearnedEncoder:
    """The leading directions of padded, pooled histories, learned from windows.

    A z-scored history gets zeros at its head up to length, is pooled by the mean of each pool
    values of this time axis, and is projected onto the eigenvectors of the Gram matrix of such
    rows, the largest first. Each eigenvector's largest component is positive, so that equal
    windows give equal encoders.
    """

    length: int
    pool: int
    matrix: np.ndarray

    @property
    def width(self) -> int:
        return len(self.matrix)

    @staticmethod
    def pooled(z: list, length: int, pool: int) -> np.ndarray:
        out = np.zeros((len(z), length))
        for row, x in zip(out, z, strict=True):
            tail = np.asarray(x, float)[-length:]
            row[length - len(tail) :] = tail
        return out.reshape(len(z), -1, pool).mean(2)

    @classmethod
    def fit(cls, windows: DataFrame, length: int = DEFAULTS.encoder_length, width: int = 32, pool: int = 4) -> LearnedEncoder:
        """From all windows' histories: each task gives one matrix of length / pool squared, and Spark sums these."""
        if length % pool or not 1 <= width <= length // pool:
            raise ValueError("pool divides length, and width is at most length / pool")
        size = length // pool

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gram = np.zeros((size, size))
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    x = cls.pooled(b.column(0).slice(at, 4096).to_pylist(), length, pool)
                    gram += x.T @ x
            row, col = np.nonzero(np.triu(gram))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(gram[row, col])], ["i", "j", "v"])

        sums = normalized(windows).select("z").mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
        gram = np.zeros((size, size))
        gram[sums["i"].to_numpy(), sums["j"].to_numpy()] = gram[sums["j"].to_numpy(), sums["i"].to_numpy()] = sums["v"].to_numpy()
        _, vectors = np.linalg.eigh(gram)
        leading = vectors[:, ::-1][:, :width].T
        signs = np.sign(leading[np.arange(width), np.abs(leading).argmax(1)])
        return cls(length, pool, leading * np.where(signs == 0, 1, signs)[:, None])

    def encode(self, windows: DataFrame) -> DataFrame:
        own = self

        @F.pandas_udf("array<double>")
        def run(z: pd.Series) -> pd.Series:
            v = own.pooled(z.tolist(), own.length, own.pool) @ own.matrix.T
            n = np.linalg.norm(v, axis=1, keepdims=True)
            return pd.Series(list(np.where(n > NORM_FLOOR, v / np.where(n > NORM_FLOOR, n, 1), 0)))

        return windows.withColumn("vector", run("z"))

    def to_json(self) -> str:
        return json.dumps({"length": self.length, "pool": self.pool, "width": self.width, "matrix": self.matrix.tolist()})

    @classmethod
    def from_json(cls, text: str) -> LearnedEncoder:
        d = json.loads(text)
        matrix = np.array(d["matrix"])
        if matrix.shape != (d["width"], d["length"] // d["pool"]):
            raise ValueError("the encoder's matrix doesn't fit its width and length")
        return cls(d["length"], d["pool"], matrix)


def normalized(windows: DataFrame) -> DataFrame:
    """windows with mu, sigma (floored) and z of their histories."""
    return windows.withColumn("_m", V.moments("history_x")).select(*windows.columns, "_m.mu", "_m.sigma", "_m.z")


def encoded(windows: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Points: windows with statistics, vector and the time features of their label."""
    out = (encoder or ZScoreEncoder()).encode(normalized(windows)).drop("z")
    return out.select("*", *time_features("label_ts")) if "label_ts" in out.columns else out


def check_length(rows: DataFrame, column: str, n: int, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows whose array has n elements, and the others; strict raises on the others instead."""
    ok = F.coalesce(F.size(column) == n, F.lit(False))
    if strict:
        return rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"{column} must have {n} values")).cast("boolean"))), rows.limit(0)
    return rows.where(ok), rows.where(~ok)


def mean_pool(rows: DataFrame, group: str, column: str) -> DataFrame:
    """The mean of each dimension over a group's vectors."""
    return rows.select(group, F.posexplode(column).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("pooled"))
