"""From hits to a forecast: distances, weights, per-step fusion and back to the series' scale."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..schema import IDW_EPS, RATIO_EPS, SIGMA_FLOOR

#: Queries whose bands are made at once.
AT_ONCE = 500


def distance(score: Column) -> Column:
    return F.when(score <= 1, 1 - score).otherwise(F.lit(0.0))


def idw_weight(query_key: str, power: float = 2.0) -> Column:
    """Inverse-distance weights of a query's hits; they add up to 1."""
    raw = 1 / (F.pow(distance(F.col("score")), F.lit(power)) + F.lit(IDW_EPS))
    return raw / F.sum(raw).over(Window.partitionBy(query_key))


def softmax_weight(query_key: str, score: Column) -> Column:
    w = Window.partitionBy(query_key)
    raw = F.exp(score - F.max(score).over(w))
    return raw / F.sum(raw).over(w)


def valid_hits(hits: DataFrame) -> DataFrame:
    """Hits with a future."""
    return hits.where(F.size(F.coalesce("future_y", F.array().cast("array<double>"))) > 0)


def future_length(queries: DataFrame, hits: DataFrame, query_key: str, default: int) -> DataFrame:
    """The length of each query's first hit's future; the default if that is empty or there is no hit."""
    first = hits.groupBy(query_key).agg(F.min_by(F.size(F.coalesce("future_y", F.array().cast("array<double>"))), "rank_no").alias("_n"))
    return queries.select(query_key).join(first, query_key, "left").select(query_key, F.coalesce(F.nullif("_n", F.lit(0)), F.lit(default)).alias("future_length"))


def fuse(hits: DataFrame, query_key: str, steps: int, normalized: bool = True) -> DataFrame:
    """query_key, step (0-based) and fused, the weighted mean of the hits' futures at each step.

    Futures are taken in their own window's z-scale, or raw as stored. Steps that only some
    hits reach are weighted by these hits alone; steps that none reaches are 0.
    """
    future = F.coalesce(F.slice("future_y", 1, steps), F.array().cast("array<double>"))
    if normalized:
        future = V.zscore(future, F.col("mu"), F.col("sigma"))
    # a row for each query, not for each step of each hit; a query's hits are few
    held = hits.groupBy(query_key).agg(F.collect_list(F.struct("weight", future.alias("y"))).alias("_hits"))

    def at(i: Column) -> Column:
        both = F.aggregate(
            "_hits", F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("w")),
            lambda s, h: F.when(F.size(h["y"]) > i, F.struct((s["y"] + F.coalesce(h["weight"] * F.get(h["y"], i), F.lit(0.0))).alias("y"), (s["w"] + F.coalesce(h["weight"], F.lit(0.0))).alias("w"))).otherwise(s),
            lambda s: F.coalesce(F.try_divide(s["y"], s["w"]), F.lit(0.0)),
        )
        return both

    return held.select(query_key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), at)).alias("step", "fused"))


def bands(hits: DataFrame, query_key: str, steps: int, normalized: bool = True, shares: tuple[float, float, float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """query_key, step, lo, mid and hi: weighted quantiles of the hits' futures at each step, on the query's scale.

    A quantile is the least future at which the weights of all futures up to it reach the share
    of the weights present at the step; nothing is interpolated. Steps that no hit reaches are left out.
    """
    future = F.slice(V.zscore("future_y", F.col("mu"), F.col("sigma")) if normalized else F.col("future_y"), 1, steps)
    # a row for each query, as in fuse(): rows for each step of each hit would be sorted twice
    held = valid_hits(hits).groupBy(query_key).agg(F.first("q_mu").alias("mu"), F.first("q_sigma").alias("sigma"), F.array_sort(F.collect_list(F.struct("rank_no", "weight", future.alias("y")))).alias("hits"))
    names = ("lo", "mid", "hi")
    schema = T.StructType([hits.schema[query_key], T.StructField("step", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                part = b.slice(lo, AT_ONCE)
                at, step, found = quantiles(part.column(3), steps, shares)
                mu, sigma = (np.asarray(part.column(i))[at] for i in (1, 2))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(step, pa.int32()), *(pa.array(x * sigma + mu, from_pandas=True) for x in found)], schema.names)

    return held.mapInArrow(run, schema)


def quantiles(hits: pa.ListArray, steps: int, shares: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row and step of each step that a row's hits (weight and y, in the order of their ranks) reach, and y at each share of the weights, not a number where none has it."""
    each = hits.flatten()
    per_row = np.diff(hits.offsets.to_numpy())
    row = np.repeat(np.arange(len(hits)), per_row)
    place = np.arange(len(each)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    futures = each.field("y")
    values, sizes = futures.flatten().to_numpy(zero_copy_only=False), np.diff(futures.offsets.to_numpy())
    step = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own, hit = np.repeat(row, sizes), np.repeat(place, sizes)
    y = np.full((len(hits), steps, int(per_row.max(initial=0))), np.inf)
    weight, there = np.zeros(y.shape), np.zeros(y.shape, bool)
    y[own, step, hit], there[own, step, hit] = values, True
    weight[own, step, hit] = np.repeat(np.asarray(each.field("weight")), sizes)
    order = np.argsort(y, axis=2, kind="stable")  # equal ones by rank
    y, upto = np.take_along_axis(y, order, 2), np.cumsum(np.take_along_axis(weight, order, 2), axis=2)
    at, step = np.nonzero(there.any(2))
    y, upto = y[at, step], upto[at, step]
    out = []
    for share in shares:
        reached = upto / upto[:, -1:] >= share - 1e-9
        first = np.take_along_axis(y, reached.argmax(1)[:, None], 1)[:, 0] if len(y) else np.zeros(0)
        out.append(np.where(reached.any(1), first, np.nan))
    return at, step, out


def agreement(of_steps: DataFrame, query_key: str) -> DataFrame:
    """query_key, width (the mean width of the bands) and movement (the deviation of their middles over the steps)."""
    return of_steps.groupBy(query_key).agg(F.avg(F.col("hi") - F.col("lo")).alias("width"), F.stddev_pop("mid").alias("movement"))


def rescaled(fused: DataFrame, queries: DataFrame, query_key: str, steps: int, no_hit_steps: int | None = None) -> DataFrame:
    """y_hat on the query's own scale; a query without any hit gets its mean for no_hit_steps steps."""
    own = queries.select(query_key, F.col("q_mu"), F.col("q_sigma"))
    out = fused.join(own, query_key).select(query_key, "step", (F.col("fused") * F.col("q_sigma") + F.col("q_mu")).alias("y_hat"))
    if no_hit_steps is None:
        return out
    none = own.join(fused.select(query_key).distinct(), query_key, "left_anti")
    return out.unionByName(none.select(query_key, F.explode(F.sequence(F.lit(0), F.lit(no_hit_steps - 1))).alias("step"), F.col("q_mu").alias("y_hat")))


def chunk_values(values: Column | str, mu: Column, sigma: Column) -> Column:
    """A hit's own future on its own scale, to 4 places; unchanged if the deviation is next to nothing."""
    scaled = F.when(sigma < SIGMA_FLOOR, values if isinstance(values, Column) else F.col(values)).otherwise(V.unzscore(values, mu, sigma))
    return F.transform(scaled, lambda x: F.round(x, 4))  # halves go up, not to the even digit


def cross_features(pairs: DataFrame) -> DataFrame:
    """pairs (q_… and … columns) with the seven features of the learned ranker."""
    def of(name: str, default: float) -> tuple[Column, Column]:
        return F.coalesce(f"q_{name}", F.lit(default)), F.coalesce(name, F.lit(default))

    (qm, m), (qs, s) = of("mu", 0.0), of("sigma", 1.0)
    same = {f"is_same_{a}": F.col(f"q_{b}").eqNullSafe(F.col(b)).cast("double") for a, b in (("month", "month"), ("time_of_day", "time_of_day"), ("weekday", "is_weekend"))}
    return pairs.withColumns(
        {"distance": distance(F.col("score")), "abs_mu_diff": F.abs(qm - m), "abs_sigma_diff": F.abs(qs - s), **same, "mu_ratio": F.coalesce(F.try_divide(m, qm + F.lit(RATIO_EPS)), F.lit(0.0))}
    )


#: The ranker's features in their order.
FEATURES = ("distance", "abs_mu_diff", "abs_sigma_diff", "is_same_month", "is_same_time_of_day", "is_same_weekday", "mu_ratio")
