"""The engine's ends: ingest, forecast, agent forecast and backtest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefeat import time_features
from ..operators import encode, filters, fusion, intent, profile, ranker, report, windows
from ..operators.search import search
from ..schema import DEFAULTS
from ..sources.staging import discard, scope, stage
from ..sources.store import Collection

KEYS = ["source", "window_idx"]


def check_k(k: int) -> None:
    if not 1 <= k <= DEFAULTS.most_k:
        raise ValueError(f"k is 1 to {DEFAULTS.most_k}")


def points_of(series: DataFrame, history: int, future: int, encoder: encode.Encoder | None = None, tie: str | None = None) -> DataFrame:
    """A series' windows as points to store or search."""
    return encode.encoded(windows.sliding_windows(series, history, future, tie=tie), encoder)


def ingest(collection: Collection, series: DataFrame, history: int, future: int, encoder: encode.Encoder | None = None, tie: str | None = None) -> int:
    """Store all windows of the series; a window that is there already is replaced."""
    return collection.upsert(points_of(series, history, future, encoder, tie), single=True)  # a place has one window


def ingest_sample(collection: Collection, history_x: list[float], future_y: list[float], history: int = DEFAULTS.history, encoder: encode.Encoder | None = None) -> int:
    """Store one sample without a source or times, under the next free window_idx, which is returned."""
    if len(history_x) != history or not future_y:
        raise ValueError(f"a sample has {history} past values and one future value at least")
    idx = collection.next_idx()
    row = [(None, idx, list(map(float, history_x)), list(map(float, future_y)))]
    rows = collection.spark.createDataFrame(row, "source string, window_idx bigint, history_x array<double>, future_y array<double>")
    collection.upsert(encode.encoded(rows, encoder), new=True)
    return idx


def as_queries(points: DataFrame, key: Column) -> DataFrame:
    """Points as queries: q_key and all columns with q_ before their names."""
    return points.select(key.alias("q_key"), *[F.col(c).alias(f"q_{c}") for c in points.columns])


def requests(rows: DataFrame, history: int, key: str = "q_key", encoder: encode.Encoder | None = None) -> DataFrame:
    """Bare histories (key, history_x) as queries; one of another length than history is an error."""
    good, _ = encode.check_length(rows.select(F.col(key).alias("_k"), "history_x"), "history_x", history, strict=True)
    points = encode.encoded(good, encoder)
    return points.select(F.col("_k").alias("q_key"), *[F.col(c).alias(f"q_{c}") for c in points.columns if c != "_k"])


def last_windows(points: DataFrame) -> DataFrame:
    """The last window of each source as a query."""
    last = points.groupBy("source").agg(F.max_by(F.struct(*points.columns), "window_idx").alias("_p"))
    return as_queries(last.select("_p.*"), F.col("source"))


def every(points: DataFrame, n: int = 20) -> DataFrame:
    """The windows whose window_idx is divisible by n as queries."""
    key = F.concat_ws("|", "source", F.col("window_idx").cast("string"))
    return as_queries(points.where(F.col("window_idx") % n == 0), key)


def hits_of(queries: DataFrame, points: DataFrame, k: int, where: Column | None = None, fallback: bool = False, threshold: float | None = None, strict: bool = False, spec: str | None = None) -> DataFrame:
    """The queries' nearest points.

    Where queries have times, hits must have ended before the query's forecast begins (strict: before its
    history does, if q_first_ts tells when), so a window is no hit of its own. spec: the queries' column of
    filters of their own, as JSON.
    """
    slim = points.select(*KEYS, "last_ts", "label_ts", "vector", "month", "hour", "is_weekend", "time_of_day", "mu", "sigma", "future_y")
    bound = "q_first_ts" if strict else "q_label_ts"
    asked = queries.select(*[c for c in queries.columns if c != "q_history_x"])
    return search(asked, slim, k, "q_key", KEYS, where, threshold, before=("last_ts", bound) if bound in queries.columns else None, fallback=fallback, spec=spec)


def asked_windows(blocks: DataFrame, n: int, history: int, future: int) -> DataFrame:
    """The windows of series blocks whose window_idx is divisible by n, as queries."""
    points = encode.encoded(windows.every_window(blocks, n, history, future))
    return as_queries(points, F.concat_ws("|", "source", F.col("window_idx").cast("string")))


def hits_in_series(queries: DataFrame, blocks: DataFrame, k: int, history: int, future: int, threshold: float | None = None, spec: str | None = None, fallback: bool = False) -> DataFrame:
    """hits_of() for z-scored histories, searched in the series themselves; only the hits' windows are cut.

    The filters of the queries' column spec are tested in the search; with fallback, those without a hit search again without one.
    """
    before = "q_label_ts" if "q_label_ts" in queries.columns else None
    found = profile.nearest(queries, blocks, k, history, future, before=before, threshold=threshold, spec=spec)
    if fallback:
        left = queries.join(found.select("q_key").distinct(), "q_key", "left_anti")
        rest = profile.nearest(left, blocks, k, history, future, before=before, threshold=threshold)
        found = stage(found.withColumn("fallback_used", F.lit(False)).unionByName(rest.withColumn("fallback_used", F.lit(True))))
    cut = windows.wanted_windows(blocks, found, history, future, columns=("label_ts", "last_ts", "future_y", "mu", "sigma")).select("*", *time_features("label_ts"))
    asked = queries.drop("q_history_x", "q_vector")
    return found.join(asked, "q_key").join(cut, KEYS)  # futures, which are wide, are shuffled once


def forecast_in_series(queries: DataFrame, blocks: DataFrame, k: int = DEFAULTS.top_k, history: int = DEFAULTS.history, steps: int = DEFAULTS.future, model: GBTRegressionModel | None = None, normalized: bool = True, no_hit_steps: int | None = None, spec: str | None = None) -> DataFrame:
    """forecast() from series blocks in place of points, each query under the filter of its own in the column spec."""
    check_k(k)
    with scope(queries.sparkSession) as keep:
        hits = stage(hits_in_series(queries, blocks, k, history, steps, spec=spec, fallback=spec is not None).drop("q_future_y", "q_question"))
        return keep(stage(fused_forecast(hits, queries, steps, model, normalized, no_hit_steps or steps, spent=True)))


def fused_forecast(hits: DataFrame, queries: DataFrame, steps: int, model: GBTRegressionModel | None = None, normalized: bool = True, no_hit_steps: int | None = None, spent: bool = False) -> DataFrame:
    """spent: the hits are staged and no later step reads them."""
    fused = stage(fusion.fuse(ranker.weighted(hits, "q_key", model), "q_key", steps, normalized))
    if spent:
        discard(hits)
    return fusion.rescaled(fused, queries, "q_key", steps, no_hit_steps)


def forecast(queries: DataFrame, points: DataFrame, k: int = DEFAULTS.top_k, steps: int = DEFAULTS.future, model: GBTRegressionModel | None = None, spec: dict | None = None, normalized: bool = True, no_hit_steps: int | None = None) -> DataFrame:
    """q_key, step and y_hat: the fused futures of each query's k nearest windows, all under the filter spec."""
    check_k(k)
    where = filters.compile_filter(spec) if filters.is_active(spec) else None
    with scope(queries.sparkSession) as keep:
        hits = stage(hits_of(queries, points, k, where, fallback=where is not None))
        return keep(stage(fused_forecast(hits, queries, steps, model, normalized, no_hit_steps or steps)))


def agent_forecast(question: str | None, queries: DataFrame, points: DataFrame, k: int = DEFAULTS.agent_top_k, steps: int = DEFAULTS.future, model: GBTRegressionModel | None = None, language_model: Callable[[str], str] | None = None, sources: tuple[str, ...] = (), history: int | None = None) -> DataFrame:
    """One JSON answer a query: filter, values, the hits behind them, report and message.

    question: of all queries, or None if each has its own in q_question; these are read by the
    rules, as columns, and each query is searched under its own filter. sources: names of
    series that a question may mention. history: the length that each query's history must
    have. A query without any hit is answered with its mean. points may be the series
    themselves, as staged blocks, if history is given.
    """
    check_k(k)
    if question is None:
        sized = F.coalesce(F.length("q_question").between(2, 500), F.lit(False))
        queries = queries.where(F.when(sized, True).otherwise(F.raise_error(F.lit("a question has 2 to 500 characters")).cast("boolean")))
        asked_for = intent.filters_of("q_question", sources)
    else:
        if not 2 <= len(question) <= 500:
            raise ValueError("a question has 2 to 500 characters")
        spec = intent.parse_intent(question, sources, language_model)
        asked_for = F.lit(json.dumps(spec) if filters.is_active(spec) else None).cast("string")
        queries = queries.withColumn("q_question", F.lit(question))
    if history is not None:
        queries, _ = encode.check_length(queries, "q_history_x", history, strict=True)
    with scope(queries.sparkSession) as keep:
        return keep(stage(_answers(queries.withColumn("q_spec", asked_for), points, k, steps, model, history)))


def _answers(queries: DataFrame, points: DataFrame, k: int, steps: int, model: GBTRegressionModel | None, history: int | None) -> DataFrame:
    queries = stage(queries)
    if "block" in points.columns:
        found = hits_in_series(queries, points, k, history, steps, spec="q_spec", fallback=True)
    else:
        found = hits_of(queries, points, k, fallback=True, spec="q_spec")
    hits = stage(found.drop("q_future_y", "q_question"))  # a question may be long, and is there once
    values = stage(fused_forecast(hits, queries, steps, model, no_hit_steps=steps))
    agreed = fusion.agreement(fusion.bands(ranker.weighted(hits, "q_key", model), "q_key", steps), "q_key")
    told = report.markdown(report.summary(values, "q_key"), report.hit_context(hits, "q_key"), queries.select("q_key", "q_question", "q_spec"), agreed, "q_key")
    own = fusion.chunk_values("future_y", F.lit(0.0), F.lit(1.0))  # futures are stored on their own scale
    chunk = F.struct("rank_no", *KEYS, F.round("score", 4).alias("score"), "month", "hour", "is_weekend", "time_of_day", own.alias("future_y"))
    chunks = hits.groupBy("q_key").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"), F.count("*").alias("n"), F.max("fallback_used").alias("fell_back"))
    series = values.groupBy("q_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "y_hat"))), lambda s: F.round(s["y_hat"], 4)).alias("values"))
    both = queries.select("q_key", "q_spec").join(series, "q_key", "left").join(chunks, "q_key", "left").join(told, "q_key", "left")
    fell_back = F.coalesce("fell_back", F.lit(False))
    message = intent.status_message(F.lit(k), F.col("q_spec").isNotNull() & ~fell_back, F.coalesce("n", F.lit(0)))
    spec_told = F.coalesce("q_spec", F.lit(json.dumps(filters.empty())))
    answer = F.to_json(F.struct(spec_told.alias("filter"), "values", "chunks", "report", fell_back.alias("fallback_used"), message.alias("message")))
    return both.select("q_key", answer.alias("answer"))


def backtest(queries: DataFrame, predicted: DataFrame) -> DataFrame:
    """mae and rmse of forecasts against the queries' own futures, per query."""
    truth = queries.select("q_key", F.posexplode("q_future_y").alias("step", "y"))
    e = F.col("y") - F.col("y_hat")
    return truth.join(predicted, ["q_key", "step"]).groupBy("q_key").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
