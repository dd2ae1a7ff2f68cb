"""Registry of the forecasting engine's queries, each with the SQL that gives the same rows.

Series are the event types of `events`; vectors are the rows of `embeddings`.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.timefeat import time_features
from ..operators import cells, encode, filters, fusion, intent, ranker, report, search, windows
from ..schema import DEFAULTS
from ..sources import series as S
from ..sources.staging import shared_dir, stage
from ..sources.store import Collection, stats, upserted
from . import forecasting as P

#: Past and future values of a window, and hits of a query.
L, H, K = DEFAULTS.history, DEFAULTS.future, DEFAULTS.top_k
#: Every so many windows or vectors one asks; all answer.
ASKS = 20
#: Past and future values in the flagship query, which runs on the smallest table.
SHORT = 24, 6

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def stamp(c: str, name: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


# ---- shared inputs

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events_series(spark, sf_dir)


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series with missing values put in: null at each 997th event, not-a-number at each 1013th."""
    hole = F.when(F.col("tie") % 997 == 0, F.lit(None)).when(F.col("tie") % 1013 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return _events(spark, sf_dir).withColumn("value", hole)


def _windows(spark: SparkSession, sf_dir: str, history: int = L, future: int = H) -> DataFrame:
    return windows.sliding_windows(_events(spark, sf_dir), history, future, tie="tie")


def _points(spark: SparkSession, sf_dir: str, history: int = L, future: int = H) -> DataFrame:
    """Staged, as queries and hits both come from them."""
    return stage(P.points_of(_events(spark, sf_dir), history, future, tie="tie"))


def _asked(spark: SparkSession, sf_dir: str, history: int = L, future: int = H) -> tuple[DataFrame, DataFrame]:
    """Every 20th window as a query, and the series that it is searched in."""
    blocks = stage(windows.series_blocks(_events(spark, sf_dir), history, future, tie="tie"))
    return stage(P.asked_windows(blocks, ASKS, history, future).drop("q_vector")), blocks  # the search takes the histories


def _hits(spark: SparkSession, sf_dir: str, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Not staged: a query that reads them once then carries only the columns that it names."""
    asked, blocks = _asked(spark, sf_dir)
    return asked, P.hits_in_series(asked, blocks, k, L, H)


def _windows_sql(history: int = L, future: int = H, source: str = "SELECT event_type AS source, ts, event_id AS tie, value FROM events") -> str:
    n = history + future
    frame = f"(PARTITION BY source ORDER BY ts, tie ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"""
        s AS ({source}),
        win AS (SELECT source, row_number() OVER w - 1 AS window_idx, lead(ts, {history}) OVER w AS label_ts, lead(ts, {n - 1}) OVER w AS last_ts,
                list(value) OVER {frame} AS v, count(CASE WHEN NOT isnan(value) THEN 1 END) OVER {frame} AS n FROM s WINDOW w AS (PARTITION BY source ORDER BY ts, tie)),
        ok AS (SELECT source, window_idx, label_ts, last_ts, v[1:{history}] AS history_x, v[{history + 1}:{n}] AS future_y FROM win WHERE n = {n})"""


def _points_sql(history: int = L, future: int = H) -> str:
    return _windows_sql(history, future) + """,
        st AS (SELECT *, list_avg(history_x) AS mu, CASE WHEN list_stddev_pop(history_x) < 1e-10 THEN 1::DOUBLE ELSE list_stddev_pop(history_x) END AS sigma FROM ok),
        zs AS (SELECT *, list_transform(history_x, lambda x: (x - mu) / sigma) AS z FROM st),
        nz AS (SELECT *, sqrt(list_sum(list_transform(z, lambda x: x * x))) AS norm FROM zs),
        pt AS MATERIALIZED (SELECT *, list_transform(z, lambda x: CASE WHEN norm > 1e-10 THEN x / norm ELSE 0 END) AS vector FROM nz)"""


def _hits_sql(history: int = L, future: int = H, k: int = K, asks: str = f"window_idx % {ASKS} = 0", q_key: str = "source || '|' || window_idx") -> str:
    return _points_sql(history, future) + f""",
        q AS MATERIALIZED (SELECT {q_key} AS q_key, source AS qs, window_idx AS qi, mu AS q_mu, sigma AS q_sigma, label_ts AS q_label_ts, future_y AS q_future_y, vector AS q_vector FROM pt WHERE {asks}),
        pairs AS (SELECT q_key, source, window_idx, list_inner_product(q_vector, vector) AS score FROM q JOIN pt ON last_ts < q_label_ts),
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY round(score, 9) DESC, source, window_idx) AS rank_no FROM pairs) WHERE rank_no <= {k}),
        hits AS MATERIALIZED (SELECT q.* EXCLUDE (q_vector), p.source, p.window_idx, p.label_ts, p.mu, p.sigma, p.future_y, score, rank_no, CASE WHEN score <= 1 THEN 1 - score ELSE 0 END AS distance
            FROM top JOIN q ON top.q_key = q.q_key JOIN pt p ON top.source = p.source AND top.window_idx = p.window_idx)"""


_IDW = "(1 / (pow(distance, 2) + 1e-10)) / sum(1 / (pow(distance, 2) + 1e-10)) OVER (PARTITION BY q_key)"
_SOFTMAX = "exp(-distance - max(-distance) OVER (PARTITION BY q_key)) / sum(exp(-distance)) OVER (PARTITION BY q_key) * exp(max(-distance) OVER (PARTITION BY q_key))"


def _forecast_sql(weight: str, normalized: bool = True, hits: str | None = None, future: int = H, used: str = "hits") -> str:
    """Up to f: q_key, step and y_hat; a query without hits has its mean at each step."""
    y = "(y - mu) / sigma" if normalized else "y"
    return f"""{hits or _hits_sql()},
        w AS (SELECT *, {weight} AS weight FROM {used}),
        long AS (SELECT q_key, q_mu, q_sigma, mu, sigma, weight, unnest(future_y) AS y, generate_subscripts(future_y, 1) - 1 AS step FROM w),
        f AS (SELECT q_key, step, sum(weight * ({y})) / sum(weight) * q_sigma + q_mu AS y_hat FROM long GROUP BY q_key, step, q_mu, q_sigma
            UNION ALL SELECT q_key, unnest(range({future})), q_mu FROM q WHERE q_key NOT IN (SELECT q_key FROM w))"""


_FORECAST = " SELECT q_key, step::INT AS step, round(y_hat, 6) AS y_hat FROM f"


def _forecast_rows(asked: DataFrame, hits: DataFrame, weight, steps: int = H, normalized: bool = True) -> DataFrame:
    fused = stage(fusion.fuse(hits.withColumn("weight", weight), "q_key", steps, normalized))
    return _told(fusion.rescaled(fused, asked, "q_key", steps, steps))


def _told(forecast: DataFrame) -> DataFrame:
    return forecast.select("q_key", "step", r6("y_hat", "y_hat"))


# ---- scans and sources

@query("""SELECT source, count(*) AS n, round(min(value), 6) AS lowest, round(max(value), 6) AS highest, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts
    FROM (SELECT l_shipdate AS ts, 'l_quantity' AS source, l_quantity AS value FROM lineitem UNION ALL SELECT l_shipdate, 'l_extendedprice', l_extendedprice FROM lineitem
        UNION ALL SELECT l_shipdate, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_shipdate, 'l_tax', l_tax FROM lineitem) GROUP BY source""")
def series_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    long = S.to_long(wide, "l_shipdate", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    times = long.groupBy("source").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return times.select("source", "n", r6("lo", "lowest"), r6("hi", "highest"), stamp("a", "first_ts"), stamp("b", "last_ts"))


_GAPS = "SELECT event_type AS source, ts, event_id AS tie, CASE WHEN event_id % 997 = 0 THEN NULL WHEN event_id % 1013 = 0 THEN 'nan'::DOUBLE ELSE value END AS value FROM events"


@query(f"SELECT source, count(*) AS n, count(*) FILTER (value IS NULL OR isnan(value)) AS missing FROM ({_GAPS}) GROUP BY source")
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.col("value").isNull() | F.isnan("value")
    return _gaps(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(missing).alias("missing"))


@query(f"""WITH {_windows_sql()} SELECT source, window_idx, strftime(label_ts, '%Y-%m-%d %H:%M:%S') AS label_ts, round(list_min(history_x), 6) AS h_min, round(list_max(history_x), 6) AS h_max,
    round(list_min(future_y), 6) AS f_min, round(list_max(future_y), 6) AS f_max, round(history_x[1], 6) AS h_first, round(future_y[{H}], 6) AS f_last FROM ok""")
def window_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    return w.select(
        "source", "window_idx", stamp("label_ts", "label_ts"), r6(F.array_min("history_x"), "h_min"), r6(F.array_max("history_x"), "h_max"),
        r6(F.array_min("future_y"), "f_min"), r6(F.array_max("future_y"), "f_max"), r6(F.element_at("history_x", 1), "h_first"), r6(F.element_at("future_y", -1), "f_last"),
    )


@query("SELECT event_type AS source, greatest(count(*) - 148 + 1, 0) AS windows FROM events GROUP BY 1")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _windows(spark, sf_dir, 100, 48).groupBy("source").agg(F.count("*").alias("windows"))
    return _events(spark, sf_dir).select("source").distinct().join(found, "source", "left").select("source", F.coalesce("windows", F.lit(0)).alias("windows"))


@query(f"""WITH {_windows_sql()} SELECT source, window_idx, strftime(label_ts, '%Y-%m-%d %H:%M:%S') AS label_ts, month(label_ts)::INT AS month, hour(label_ts)::INT AS hour,
    round(list_min(history_x), 6) AS min_history_x, round(list_max(history_x), 6) AS max_history_x, round(list_min(future_y), 6) AS min_future_y, round(list_max(future_y), 6) AS max_future_y FROM ok WHERE window_idx < 3""")
def window_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = windows.preview(_windows(spark, sf_dir))
    names = ["min_history_x", "max_history_x", "min_future_y", "max_future_y"]
    return p.select("source", "window_idx", stamp("label_ts", "label_ts"), F.month("label_ts").alias("month"), F.hour("label_ts").alias("hour"), *[r6(n, n) for n in names])


@query(f"WITH {_windows_sql(source=_GAPS)} SELECT source, window_idx, round(list_avg(history_x), 6) AS mu FROM ok")
def window_nan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.sliding_windows(_gaps(spark, sf_dir), L, H, tie="tie")
    return w.select("source", "window_idx", r6(V.mean("history_x"), "mu"))


@query(f"WITH {_windows_sql()} SELECT source, (window_idx // 500)::BIGINT AS batch_no, count(*) AS n, min(window_idx) AS first_idx FROM ok GROUP BY 1, 2")
def ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = windows.batches(_windows(spark, sf_dir), 500)
    return b.groupBy("source", "batch_no").agg(F.count("*").alias("n"), F.min("window_idx").alias("first_idx"))


# ---- array mathematics

@query(f"WITH {_points_sql()} SELECT source, window_idx, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM st")
def zscore_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.normalized(_windows(spark, sf_dir)).select("source", "window_idx", r6("mu", "mu"), r6("sigma", "sigma"))


@query(f"WITH {_points_sql()} SELECT source, window_idx, (generate_subscripts(z, 1) - 1)::INT AS pos, round(unnest(z), 6) AS z FROM zs")
def zscore_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = encode.normalized(_windows(spark, sf_dir))
    return n.select("source", "window_idx", F.posexplode("z").alias("pos", "z")).select("source", "window_idx", "pos", r6("z", "z"))


@query(f"SELECT event_type AS source, count(*) - {L + H} + 1 AS n, 0::DOUBLE AS worst FROM events GROUP BY 1 HAVING count(*) >= {L + H}")
def zscore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = encode.normalized(_windows(spark, sf_dir))
    error = F.array_max(F.zip_with(V.unzscore("z", F.col("mu"), F.col("sigma")), "history_x", lambda a, b: F.abs(a - b)))
    return n.groupBy("source").agg(F.count("*").alias("n"), r6(F.max(error), "worst"))


@query("""WITH c AS (SELECT source, list_transform(range(100), lambda i: x) AS a FROM (SELECT event_type AS source, max(event_id)::DOUBLE / 8 AS x FROM events GROUP BY 1)),
    m AS (SELECT source, a, list_avg(a) AS mu, CASE WHEN list_stddev_pop(a) < 1e-10 THEN 1::DOUBLE ELSE list_stddev_pop(a) END AS sigma FROM c)
    SELECT source, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(list_min(list_transform(a, lambda v: (v - mu) / sigma)), 6) AS z_min, round(list_max(list_transform(a, lambda v: (v - mu) / sigma)), 6) AS z_max FROM m""")
def zscore_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = _events(spark, sf_dir).groupBy("source").agg((F.max("tie").cast("double") / 8).alias("x"))
    flat = level.select("source", F.array_repeat("x", 100).alias("history_x"))
    return encode.normalized(flat).select("source", r6("mu", "mu"), r6("sigma", "sigma"), r6(F.array_min("z"), "z_min"), r6(F.array_max("z"), "z_max"))


_TOD = "CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END"


@query(f"SELECT event_id, month(ts)::INT AS month, hour(ts)::INT AS hour, isodow(ts) >= 6 AS is_weekend, {_TOD} AS time_of_day FROM events")
def time_feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", *time_features("ts"))


@query(f"SELECT {_TOD} AS time_of_day, isodow(ts) >= 6 AS is_weekend, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def time_of_day_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("value", *time_features("ts"))
    return rows.groupBy("time_of_day", "is_weekend").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"))


_E = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"""SELECT vec_id, n, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v), 6) AS x FROM (
    SELECT vec_id, 80 AS n, list_concat(list_transform(range(16), lambda i: 0::DOUBLE), {_E}) AS v FROM embeddings UNION ALL SELECT vec_id, 48, ({_E})[17:64] FROM embeddings)""")
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    each = [e.select("vec_id", F.lit(n).alias("n"), F.posexplode(V.fit_length("embedding", n)).alias("pos", "x")) for n in (80, 48)]
    return each[0].unionByName(each[1]).select("vec_id", "n", "pos", r6("x", "x"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


@query(f"SELECT label, dim::INT AS dim, round(avg(x), 6) AS pooled FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest({_E}) AS x FROM embeddings) GROUP BY 1, 2")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.mean_pool(_vectors(spark, sf_dir), "label", "embedding").select("label", "dim", r6("pooled", "pooled"))


@query(f"""SELECT vec_id, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(list_transform(v, lambda x: CASE WHEN norm > 1e-10 THEN x / norm ELSE 0 END)), 6) AS x FROM (
    SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM (SELECT vec_id, list_transform({_E}, lambda x: x * (vec_id % 10)) AS v FROM embeddings))""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir).withColumn("v", F.transform("embedding", lambda x: x * (F.col("vec_id") % 10)))
    return e.select("vec_id", F.posexplode(V.l2("v")).alias("pos", "x")).select("vec_id", "pos", r6("x", "x"))


@query("SELECT (vec_id % 3 <> 0) AS valid, count(*) AS n FROM embeddings GROUP BY 1")
def validate_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    good, bad = encode.check_length(_vectors(spark, sf_dir).withColumn("embedding", cut), "embedding", 64)
    return good.select(F.lit(True).alias("valid")).unionByName(bad.select(F.lit(False).alias("valid"))).groupBy("valid").agg(F.count("*").alias("n"))


# ---- vector search: every 20th vector asks, all others answer

def _knn(spark: SparkSession, sf_dir: str, k: int = K, spec: dict | None = None, nulls: bool = False, **kw) -> DataFrame:
    points = _vectors(spark, sf_dir).select("vec_id", V.l2("embedding").alias("vector"), F.when(F.col("vec_id") % 7 != 0, F.col("label")).alias("month") if nulls else F.col("label").alias("month"))
    asked = points.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_key"), F.col("vector").alias("q_vector"))
    asked = asked.withColumn("spec", F.lit(json.dumps(spec) if spec else None).cast("string"))
    return cells.search(asked, cells.build(points, ["vec_id"]), k, "q_key", exclude="vec_id", spec="spec", **kw)


def _knn_rows(hits: DataFrame) -> DataFrame:
    return hits.select("q_key", "rank_no", "vec_id", r6("score", "score"))


def _knn_sql(where: str = "true", k: int = K, payload: str = "label", more: str = "") -> str:
    return f"""WITH e AS (SELECT vec_id, {_E} AS v, {payload} AS month FROM embeddings),
        pairs AS (SELECT q.vec_id AS q_key, p.vec_id, p.month, list_cosine_similarity(q.v, p.v) AS score FROM e q JOIN e p ON q.vec_id <> p.vec_id AND q.vec_id % 20 = 0 AND ({where})),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY round(score, 9) DESC, vec_id)::INT AS rank_no FROM pairs {more})
        SELECT q_key, rank_no, vec_id, round(score, 6) AS score FROM ranked WHERE rank_no <= {k}"""


@query(_knn_sql())
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn_rows(_knn(spark, sf_dir))


@query(_knn_sql(more="WHERE score >= 0.2"))
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn_rows(_knn(spark, sf_dir, threshold=0.2))


def _condition(**c) -> dict:
    return {"key": "month", **c}


@query(_knn_sql("p.month = 3"))
def knn_filter_must(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn_rows(_knn(spark, sf_dir, spec={"must": [_condition(match={"value": 3})]}))


@query(_knn_sql("p.month = 1 OR p.month = 8"))
def knn_filter_should(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn_rows(_knn(spark, sf_dir, spec={"should": [_condition(match={"value": 1}), _condition(match={"value": 8})]}))


@query(_knn_sql("NOT coalesce(p.month = 3, false) AND NOT coalesce(p.month >= 7 AND p.month < 9, false)"))
def knn_filter_must_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn_rows(_knn(spark, sf_dir, spec={"must_not": [_condition(match={"value": 3}), _condition(range={"gte": 7, "lt": 9})]}))


@query(_knn_sql("p.month >= 2 AND p.month < 5"))
def knn_filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn_rows(_knn(spark, sf_dir, spec={"must": [_condition(range={"gte": 2, "lt": 5})]}))


@query(_knn_sql("p.month IN (0, 4, 9)"))
def knn_filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn_rows(_knn(spark, sf_dir, spec={"must": [_condition(match={"any": [0, 4, 9]})]}))


@query(_knn_sql("NOT coalesce(p.month = 3, false)", payload="CASE WHEN vec_id % 7 <> 0 THEN label END"))
def knn_filter_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn_rows(_knn(spark, sf_dir, spec={"must_not": [_condition(match={"value": 3})]}, nulls=True))


@query(f"""WITH e AS (SELECT vec_id, {_E} AS v, label AS month FROM embeddings),
    pairs AS (SELECT * FROM (SELECT q.vec_id AS q_key, p.vec_id, list_cosine_similarity(q.v, p.v) AS score, p.month = 3 AS pass FROM e q JOIN e p ON q.vec_id <> p.vec_id AND q.vec_id % 20 = 0) WHERE score >= 0.25),
    kept AS (SELECT * FROM (SELECT *, bool_or(pass) OVER (PARTITION BY q_key) AS hit FROM pairs) WHERE pass OR NOT hit),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY round(score, 9) DESC, vec_id)::INT AS rank_no FROM kept)
    SELECT q_key, rank_no, vec_id, round(score, 6) AS score, NOT hit AS fallback_used FROM ranked WHERE rank_no <= {K}""")
def knn_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some queries have a hit of label 3 at that score, the others fall back to all labels."""
    hits = _knn(spark, sf_dir, spec={"must": [_condition(match={"value": 3})]}, threshold=0.25, fallback=True)
    return hits.select("q_key", "rank_no", "vec_id", r6("score", "score"), "fallback_used")


_ASKED_FOR = ("on weekends", "workday load", "late night", "peak hours", "summer nights", "in July")


@query(f"""WITH e AS (SELECT vec_id, {_E} AS v, label + 1 AS month, vec_id % 24 AS hour, vec_id % 7 >= 5 AS is_weekend, CASE WHEN vec_id % 24 < 6 THEN 'night' WHEN vec_id % 24 < 12 THEN 'morning' WHEN vec_id % 24 < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day FROM embeddings),
    n AS (SELECT count(*) AS n FROM embeddings),
    asked AS (SELECT conv_id AS q_key, conv_id % n AS vec_id, lower(text || ' ' || list_extract({list(_ASKED_FOR)}, (conv_id % 6 + 1)::INT)) AS q FROM conversations, n WHERE turn = 0),
    rules AS (SELECT *, q LIKE '%weekend%' OR q LIKE '%周末%' AS we, q LIKE '%workday%' OR q LIKE '%weekday%' OR q LIKE '%工作日%' AS wd, q LIKE '%july%' OR q LIKE '%七月%' OR q LIKE '%7月%' AS july,
        q LIKE '%peak%' OR q LIKE '%高峰%' AS peak, q LIKE '%summer%' OR q LIKE '%夏季%' OR q LIKE '%夏天%' OR q LIKE '%peak%' OR q LIKE '%高峰%' AS summer, q LIKE '%late night%' OR q LIKE '%深夜%' OR q LIKE '%凌晨%' AS late FROM asked),
    pairs AS (SELECT q_key, p.vec_id, list_cosine_similarity(s.v, p.v) AS score,
        (NOT we OR p.is_weekend) AND (NOT wd OR NOT p.is_weekend) AND (NOT july OR p.month = 7) AND (NOT peak OR p.time_of_day = 'evening') AND (NOT summer OR (p.month >= 6 AND p.month < 9)) AND (NOT late OR p.time_of_day = 'night') AS pass
        FROM rules r JOIN e s ON r.vec_id = s.vec_id JOIN e p ON p.vec_id <> q_key),
    kept AS (SELECT * FROM (SELECT *, bool_or(pass) OVER (PARTITION BY q_key) AS hit FROM pairs WHERE score >= 0.2) WHERE pass OR NOT hit),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY round(score, 9) DESC, vec_id)::INT AS rank_no FROM kept)
    SELECT q_key, rank_no, vec_id, round(score, 6) AS score, NOT hit AS fallback_used FROM ranked WHERE rank_no <= {K}""")
def knn_filter_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation asks with a vector and the filter that its question names; those without a hit under it fall back."""
    e = _vectors(spark, sf_dir)
    hour = F.col("vec_id") % 24
    tod = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")
    points = e.select("vec_id", V.l2("embedding").alias("vector"), (F.col("label") + 1).alias("month"), hour.alias("hour"), (F.col("vec_id") % 7 >= 5).alias("is_weekend"), tod.alias("time_of_day"))
    said = F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, _ASKED_FOR)), (F.col("conv_id") % len(_ASKED_FOR) + 1).cast("int")))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 0")
    asks = turns.select(F.col("conv_id").alias("q_key"), (F.col("conv_id") % F.lit(e.count())).alias("_vec"), intent.filters_of(said).alias("spec"))
    asked = asks.join(points.select(F.col("vec_id").alias("_vec"), F.col("vector").alias("q_vector")), "_vec").drop("_vec")
    hits = cells.search(asked, cells.build(points, ["vec_id"]), K, "q_key", threshold=0.2, exclude="vec_id", spec="spec", fallback=True)
    return hits.select("q_key", "rank_no", "vec_id", r6("score", "score"), "fallback_used")


_KNN_HITS = _knn_sql().replace("round(score, 6) AS score", "score")


@query(f"SELECT q_key, rank_no, round(CASE WHEN score <= 1 THEN 1 - score ELSE 0 END, 6) AS distance FROM ({_KNN_HITS})")
def score_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).select("q_key", "rank_no", r6(fusion.distance(F.col("score")), "distance"))


@query(f"SELECT q_key, rank_no, round({_IDW}, 6) AS weight FROM (SELECT *, CASE WHEN score <= 1 THEN 1 - score ELSE 0 END AS distance FROM ({_KNN_HITS}))")
def idw_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).select("q_key", "rank_no", r6(fusion.idw_weight("q_key"), "weight"))


@query(f"SELECT q_key, rank_no, round(exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY q_key), 6) AS weight FROM (SELECT *, max(score) OVER (PARTITION BY q_key) AS m FROM ({_KNN_HITS}))")
def softmax_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).select("q_key", "rank_no", r6(fusion.softmax_weight("q_key", F.col("score")), "weight"))


# ---- hits of every 20th window among all windows that ended before its forecast begins

def _tod(ts: str) -> str:
    return _TOD.replace("(ts)", f"({ts})")


@query(f"""WITH {_hits_sql()} SELECT q_key, rank_no::INT AS rank_no, round(distance, 6) AS distance, round(abs(q_mu - mu), 6) AS abs_mu_diff, round(abs(q_sigma - sigma), 6) AS abs_sigma_diff,
    (month(q_label_ts) = month(label_ts))::INT::DOUBLE AS is_same_month, ({_tod('q_label_ts')} = {_tod('label_ts')})::INT::DOUBLE AS is_same_time_of_day,
    ((isodow(q_label_ts) >= 6) = (isodow(label_ts) >= 6))::INT::DOUBLE AS is_same_weekday, round(mu / (q_mu + 1e-6), 6) AS mu_ratio FROM hits""")
def cross_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = _hits(spark, sf_dir)
    return fusion.cross_features(hits).select("q_key", "rank_no", *[r6(f, f) for f in fusion.FEATURES])


_PEARSON = "CASE WHEN list_stddev_pop(a) < 1e-10 OR list_stddev_pop(b) < 1e-10 THEN 0 ELSE list_inner_product(list_transform(a, lambda x: x - list_avg(a)), list_transform(b, lambda x: x - list_avg(b))) / (len(a) * list_stddev_pop(a) * list_stddev_pop(b)) END"


@query(f"WITH {_hits_sql()} SELECT q_key, rank_no::INT AS rank_no, round({_PEARSON}, 6) AS quality FROM (SELECT q_key, rank_no, q_future_y AS a, future_y AS b FROM hits)")
def pearson_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = _hits(spark, sf_dir)
    return hits.select("q_key", "rank_no", r6(V.pearson("q_future_y", "future_y"), "quality"))


@query(f"""WITH {_hits_sql(k=20)}, l AS (SELECT {_PEARSON} AS y FROM (SELECT q_future_y AS a, future_y AS b FROM hits))
    SELECT count(*) AS n, round(min(y), 6) AS lowest, round(max(y), 6) AS highest, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS deviation, round(avg((y > 0)::INT), 6) AS positive_share FROM l""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = _hits(spark, sf_dir, 20)
    y = V.pearson("q_future_y", "future_y")
    return hits.select(y.alias("y")).agg(
        F.count("*").alias("n"), r6(F.min("y"), "lowest"), r6(F.max("y"), "highest"), r6(F.avg("y"), "mean"), r6(F.stddev_pop("y"), "deviation"), r6(F.avg((F.col("y") > 0).cast("double")), "positive_share")
    )


def _holes(hits: DataFrame) -> DataFrame:
    """Hits of even rank lose their future, each third one keeps a shorter one."""
    none = F.array().cast("array<double>")
    return hits.withColumn("future_y", F.when(F.col("rank_no") % 2 == 0, none).when(F.col("rank_no") % 3 == 0, F.slice("future_y", 1, 3)).otherwise(F.col("future_y")))


_HOLES = "SELECT * REPLACE (CASE WHEN rank_no % 2 = 0 THEN [] WHEN rank_no % 3 = 0 THEN future_y[1:3] ELSE future_y END AS future_y) FROM hits"


@query(f"WITH {_hits_sql()} SELECT q_key, rank_no::INT AS rank_no, len(future_y)::INT AS n FROM ({_HOLES}) WHERE len(future_y) > 0")
def valid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = _hits(spark, sf_dir)
    return fusion.valid_hits(_holes(hits)).select("q_key", "rank_no", F.size("future_y").alias("n"))


@query(f"""WITH {_hits_sql()}, c AS (SELECT q_key, len(future_y[1:(window_idx % 4)::INT])::INT AS n FROM hits WHERE rank_no = 1)
    SELECT q.q_key, CASE WHEN c.n > 0 THEN c.n ELSE 48 END AS future_length FROM q LEFT JOIN c ON q.q_key = c.q_key""")
def future_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Futures are cut to 0 to 3 values, so that some are empty; the first windows have no hit."""
    asked, hits = _hits(spark, sf_dir)
    cut = hits.withColumn("future_y", F.slice("future_y", F.lit(1), (F.col("window_idx") % 4).cast("int")))
    return fusion.future_length(asked, cut, "q_key", 48)


@query("WITH " + _forecast_sql(_IDW) + _FORECAST)
def forecast_idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, blocks = _asked(spark, sf_dir)
    return _told(P.forecast_in_series(asked, blocks, K, L, H))


_LAST = _hits_sql(*SHORT, asks="window_idx = (SELECT max(x.window_idx) FROM pt x WHERE x.source = pt.source)", q_key="source")


@query("WITH " + _forecast_sql(_IDW, hits=_LAST, future=SHORT[1]) + _FORECAST)
def forecast_idw_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast after the last window of each series, by short windows, so that the smallest table has hits."""
    points = _points(spark, sf_dir, *SHORT)
    return _told(P.forecast(P.last_windows(points), points, K, SHORT[1]))


@query(f"""WITH {_hits_sql()}, w AS (SELECT *, {_IDW} AS weight FROM hits),
    long AS (SELECT q_key, q_mu, q_sigma, rank_no, mu, sigma, weight, unnest(future_y) AS y0, generate_subscripts(future_y, 1) - 1 AS step FROM w),
    z AS (SELECT *, (y0 - mu) / sigma AS y FROM long),
    c AS (SELECT *, sum(weight) OVER (PARTITION BY q_key, step ORDER BY y, rank_no ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY q_key, step) AS reached FROM z)
    SELECT q_key, step::INT AS step, round(min(CASE WHEN reached >= 0.1 - 1e-9 THEN y * q_sigma + q_mu END), 6) AS lo, round(min(CASE WHEN reached >= 0.5 - 1e-9 THEN y * q_sigma + q_mu END), 6) AS mid,
        round(min(CASE WHEN reached >= 0.9 - 1e-9 THEN y * q_sigma + q_mu END), 6) AS hi FROM c GROUP BY q_key, step""")
def forecast_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted quantiles of the hits' futures at each step."""
    _, hits = _hits(spark, sf_dir)
    b = fusion.bands(ranker.weighted(hits, "q_key"), "q_key", H)
    return b.select("q_key", "step", r6("lo", "lo"), r6("mid", "mid"), r6("hi", "hi"))


@query("WITH " + _forecast_sql(_IDW, normalized=False) + _FORECAST)
def forecast_as_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, blocks = _asked(spark, sf_dir)
    return _told(P.forecast_in_series(asked, blocks, K, L, H, normalized=False))


def _with_turn(spark: SparkSession, sf_dir: str, asked: DataFrame, told) -> DataFrame:
    """Queries with what told gives for the first turn of a conversation and for a phrase; conversations are taken in turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 0")
    phrase = F.element_at(F.array(*map(F.lit, _ASKED_FOR)), (F.col("conv_id") % len(_ASKED_FOR) + 1).cast("int"))
    own = F.floor(F.col("q_window_idx") / ASKS) % F.lit(turns.agg(F.max("conv_id") + 1).first()[0])
    return asked.withColumn("conv_id", own).join(turns.select("conv_id", told(F.col("text"), phrase)), "conv_id").drop("conv_id")


def _questioned(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """Queries with a question of a request's length, which is 500 characters at most."""
    return _with_turn(spark, sf_dir, asked, lambda text, phrase: F.concat_ws(" ", F.substring(text, 1, 400), phrase).alias("q_question"))


def _with_filter(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """Queries with the filter of a whole turn and a phrase; the texts themselves stay where they are."""
    return stage(_with_turn(spark, sf_dir, asked, lambda text, phrase: intent.filters_of(F.concat_ws(" ", text, phrase)).alias("q_spec")))


def _asked_hits_sql() -> str:
    """Hits under the filter of each query's question; those without one under none."""
    base = _points_sql()
    return base + f""",
        said AS (SELECT conv_id, lower(text || ' ' || list_extract({list(_ASKED_FOR)}, (conv_id % 6 + 1)::INT)) AS t FROM conversations WHERE turn = 0),
        rules AS (SELECT conv_id, t LIKE '%weekend%' OR t LIKE '%周末%' AS we, t LIKE '%workday%' OR t LIKE '%weekday%' OR t LIKE '%工作日%' AS wd, t LIKE '%july%' OR t LIKE '%七月%' OR t LIKE '%7月%' AS july,
            t LIKE '%peak%' OR t LIKE '%高峰%' AS peak, t LIKE '%summer%' OR t LIKE '%夏季%' OR t LIKE '%夏天%' OR t LIKE '%peak%' OR t LIKE '%高峰%' AS summer, t LIKE '%late night%' OR t LIKE '%深夜%' OR t LIKE '%凌晨%' AS late FROM said),
        q AS MATERIALIZED (SELECT source || '|' || window_idx AS q_key, mu AS q_mu, sigma AS q_sigma, label_ts AS q_label_ts, future_y AS q_future_y, vector AS q_vector, rules.* FROM pt JOIN rules ON (window_idx // {ASKS}) % (SELECT max(conv_id) + 1 FROM conversations) = conv_id WHERE window_idx % {ASKS} = 0),
        pairs AS (SELECT q_key, source, window_idx, list_inner_product(q_vector, vector) AS score,
            (NOT we OR isodow(label_ts) >= 6) AND (NOT wd OR isodow(label_ts) < 6) AND (NOT july OR month(label_ts) = 7) AND (NOT peak OR hour(label_ts) >= 18) AND (NOT summer OR month(label_ts) BETWEEN 6 AND 8) AND (NOT late OR hour(label_ts) < 6) AS pass
            FROM q JOIN pt ON last_ts < q_label_ts),
        kept AS (SELECT * FROM (SELECT *, bool_or(pass) OVER (PARTITION BY q_key) AS hit FROM pairs) WHERE pass OR NOT hit),
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY round(score, 9) DESC, source, window_idx) AS rank_no FROM kept) WHERE rank_no <= {K}),
        hits AS MATERIALIZED (SELECT q.* EXCLUDE (q_vector), p.source, p.window_idx, p.label_ts, p.mu, p.sigma, p.future_y, score, rank_no, NOT hit AS fallback_used, CASE WHEN score <= 1 THEN 1 - score ELSE 0 END AS distance
            FROM top JOIN q ON top.q_key = q.q_key JOIN pt p ON top.source = p.source AND top.window_idx = p.window_idx)"""


@query(f"WITH {_asked_hits_sql()} SELECT q_key, rank_no::INT AS rank_no, source, window_idx, round(score, 6) AS score, fallback_used FROM hits")
def hits_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asking window has the question of a conversation, whose filter is its own."""
    asked, blocks = _asked(spark, sf_dir)
    own = _with_filter(spark, sf_dir, asked)
    hits = P.hits_in_series(own, blocks, K, L, H, spec="q_spec", fallback=True)
    return hits.select("q_key", "rank_no", "source", "window_idx", r6("score", "score"), "fallback_used")


@query("WITH " + _forecast_sql(_IDW, hits=_asked_hits_sql()) + _FORECAST)
def forecast_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, blocks = _asked(spark, sf_dir)
    own = _with_filter(spark, sf_dir, asked)
    return _told(P.forecast_in_series(own, blocks, K, L, H, spec="q_spec"))


@query("WITH " + _forecast_sql(_SOFTMAX) + _FORECAST)
def forecast_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _hits(spark, sf_dir)
    return _forecast_rows(asked, hits, fusion.softmax_weight("q_key", -fusion.distance(F.col("score"))))


@query(f"WITH {_points_sql()} SELECT source || '|' || window_idx AS q_key, unnest(range(10))::INT AS step, round(mu, 6) AS y_hat FROM pt WHERE window_idx % {ASKS} = 0")
def forecast_no_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return _told(P.forecast(P.every(points, ASKS), points.where("false"), K, H, no_hit_steps=10))


@query("WITH " + _forecast_sql(_IDW, hits=f"{_hits_sql()}, ragged AS (SELECT * FROM ({_HOLES}) WHERE len(future_y) > 0)", used="ragged") + _FORECAST)
def forecast_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _hits(spark, sf_dir)
    return _forecast_rows(asked, fusion.valid_hits(_holes(hits)), fusion.idw_weight("q_key"))


@query(f"WITH {_hits_sql()} SELECT q_key, rank_no::INT AS rank_no, round(score, 6) AS score, (generate_subscripts(future_y, 1) - 1)::INT AS step, round(unnest(list_transform(future_y, lambda y: CASE WHEN sigma < 1e-10 THEN y ELSE y * sigma + mu END)), 4) AS y FROM hits")
def chunk_denorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = _hits(spark, sf_dir)
    return hits.select("q_key", "rank_no", r6("score", "score"), F.posexplode(fusion.chunk_values("future_y", F.col("mu"), F.col("sigma"))).alias("step", "y"))


@query(f"""WITH {_forecast_sql(_IDW)},
    g AS (SELECT q_key, count(*) AS n, min(y_hat) AS lo, max(y_hat) AS hi, avg(y_hat) AS m, regr_slope(y_hat, step) * (count(*) - 1) AS change, stddev_pop(y_hat) AS sd FROM f GROUP BY q_key)
    SELECT q_key, n, round(lo, 6) AS lowest, round(hi, 6) AS highest, round(m, 6) AS mean, CASE WHEN change > sd THEN 'rising' WHEN change < -sd THEN 'falling' ELSE 'oscillating' END AS trend FROM g""")
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, blocks = _asked(spark, sf_dir)
    s = report.summary(P.forecast_in_series(asked, blocks, K, L, H), "q_key")
    return s.select("q_key", "n", r6("lowest", "lowest"), r6("highest", "highest"), r6("mean", "mean"), "trend")


@query(f"""WITH {_hits_sql()}, t AS (SELECT q_key, {_tod('label_ts')} AS time_of_day, isodow(label_ts) >= 6 AS we FROM hits),
    c AS (SELECT q_key, time_of_day, row_number() OVER (PARTITION BY q_key ORDER BY count(*) DESC, time_of_day) AS r FROM t GROUP BY 1, 2)
    SELECT t.q_key, count(*) AS n_hits, round(avg(we::INT), 6) AS weekend_share, any_value(c.time_of_day) AS time_of_day FROM t JOIN c ON t.q_key = c.q_key AND r = 1 GROUP BY t.q_key""")
def hit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = _hits(spark, sf_dir)
    hits = stage(hits.select("q_key", "time_of_day", "is_weekend", "score", "future_y"))
    return report.hit_context(hits, "q_key").select("q_key", "n_hits", r6("weekend_share", "weekend_share"), "time_of_day")


_ERRORS = f"""WITH {_forecast_sql(_IDW)},
    t AS (SELECT q_key, unnest(q_future_y) AS y, generate_subscripts(q_future_y, 1) - 1 AS step FROM q), e AS (SELECT t.q_key, y, y_hat FROM t JOIN f ON t.q_key = f.q_key AND t.step = f.step)"""


@query(_ERRORS + " SELECT q_key, count(*) AS n, round(avg(abs(y - y_hat)), 9) AS mae, round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) AS rmse FROM e GROUP BY q_key")
def backtest_mae_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, blocks = _asked(spark, sf_dir)
    return P.backtest(asked, P.forecast_in_series(asked, blocks, K, L, H)).select("q_key", "n", F.round("mae", 9).alias("mae"), r6("rmse", "rmse"))


@query(_ERRORS + " SELECT count(*) AS n, round(avg(abs(y - y_hat)), 9) AS mae, round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) AS rmse, round(1 - avg((y - y_hat) * (y - y_hat)) / var_pop(y), 6) AS r2 FROM e")
def regression_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, blocks = _asked(spark, sf_dir)
    truth = asked.select("q_key", F.posexplode("q_future_y").alias("step", "y"))
    both = truth.join(P.forecast_in_series(asked, blocks, K, L, H), ["q_key", "step"])
    return ranker.regression_errors(both, "y", "y_hat").select("n", F.round("mae", 9).alias("mae"), r6("rmse", "rmse"), r6("r2", "r2"))


@query(f"WITH {_windows_sql()} SELECT source, window_idx FROM ok ORDER BY md5('42|' || source || '|' || window_idx), source, window_idx LIMIT 200")
def sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sample_windows(_windows(spark, sf_dir), 200).select("source", "window_idx")


@query("SELECT vec_id, ('0x' || substr(md5('42|' || vec_id), 1, 8))::BIGINT % 100 >= 80 AS held FROM embeddings")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", ranker.is_validation("vec_id").alias("held"))


@query("""SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN value + 1000 ELSE value END, 6) AS value FROM events
    UNION ALL SELECT event_id + 1000000000000, round(value - 1000, 6) FROM events WHERE event_id % 3 = 0""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, every fifth with a new value, and some under new keys."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    changed = e.where("event_id % 5 = 0").withColumn("value", F.col("value") + 1000)
    added = e.where("event_id % 3 = 0").select((F.col("event_id") + 1000000000000).alias("event_id"), (F.col("value") - 1000).alias("value"))
    return upserted(e, changed.unionByName(added), ["event_id"]).select("event_id", r6("value", "value"))


@query(f"""WITH {_points_sql()} SELECT source, count(*) AS points, round(avg(mu + (window_idx % {ASKS} = 0)::INT), 6) AS mu, max(len(vector))::INT AS vector_width, count(*) FILTER (isodow(label_ts) >= 6) AS weekend FROM pt GROUP BY source""")
def collection_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of all windows, every 20th upserted with another mean, read back."""
    made = Collection(spark, f"{shared_dir(spark)}/collection-{spark.sparkContext.applicationId}-{sf_dir.strip('/').replace('/', '-')}", L)
    made.drop()
    made.create()
    P.ingest(made, _events(spark, sf_dir), L, H, tie="tie")
    made.upsert(made.read().where(f"window_idx % {ASKS} = 0").withColumn("mu", F.col("mu") + 1))
    return made.read(width=F.size("vector")).groupBy("source").agg(F.count("*").alias("points"), r6(F.avg("mu"), "mu"), F.max("width").alias("vector_width"), F.count_if("is_weekend").alias("weekend"))


@query("SELECT count(*) AS points, count(embedding) AS vectors, max(len(embedding))::INT AS vector_width, 'ok' AS status FROM embeddings")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")


_QUESTIONS = ("weekend peak in summer", "Workday mornings", "late night in July", "anything at all", "夏季周末", "高峰 load", "purchase on weekends", "  ")


@query(f"""WITH l AS (SELECT conv_id, lower(text || ' ' || list_extract({list(_QUESTIONS)}, (conv_id % {len(_QUESTIONS)} + 1)::INT)) AS q FROM conversations WHERE turn = 0),
    weekend AS (SELECT conv_id FROM l WHERE q LIKE '%weekend%' OR q LIKE '%周末%'), workday AS (SELECT conv_id FROM l WHERE q LIKE '%workday%' OR q LIKE '%weekday%' OR q LIKE '%工作日%'),
    july AS (SELECT conv_id FROM l WHERE q LIKE '%july%' OR q LIKE '%七月%' OR q LIKE '%7月%'), peak AS (SELECT conv_id FROM l WHERE q LIKE '%peak%' OR q LIKE '%高峰%'),
    summer AS (SELECT conv_id FROM l WHERE q LIKE '%summer%' OR q LIKE '%夏季%' OR q LIKE '%夏天%' UNION SELECT conv_id FROM peak), night AS (SELECT conv_id FROM l WHERE q LIKE '%late night%' OR q LIKE '%深夜%' OR q LIKE '%凌晨%'),
    named AS (SELECT conv_id FROM l WHERE list_contains(regexp_split_to_array(replace(q, ',', ' '), '\\s+'), 'purchase'))
    SELECT conv_id, 'is_weekend' AS key, 'value' AS op, 'true' AS wanted FROM weekend UNION ALL SELECT conv_id, 'is_weekend', 'value', 'false' FROM workday UNION ALL SELECT conv_id, 'month', 'value', '7' FROM july
    UNION ALL SELECT conv_id, 'time_of_day', 'value', '"evening"' FROM peak UNION ALL SELECT conv_id, 'month', 'gte', '6' FROM summer UNION ALL SELECT conv_id, 'month', 'lt', '9' FROM summer
    UNION ALL SELECT conv_id, 'time_of_day', 'value', '"night"' FROM night UNION ALL SELECT conv_id, 'source', 'value', '"purchase"' FROM named""")
def intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bound or value that the filter of a conversation's question asks for; a question is its first turn and a phrase."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 0")
    said = F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, _QUESTIONS)), (F.col("conv_id") % len(_QUESTIONS) + 1).cast("int")))
    spec = F.from_json(intent.filters_of(said, ("purchase", "view")), "must array<struct<key string, match map<string, string>, range map<string, string>>>")
    each = turns.select("conv_id", F.explode(spec["must"]).alias("c")).select("conv_id", "c.key", F.explode(F.coalesce("c.match", "c.range")).alias("op", "wanted"))
    return each.select("conv_id", "key", "op", F.when(F.col("key").isin("time_of_day", "source"), F.concat(F.lit('"'), "wanted", F.lit('"'))).otherwise(F.col("wanted")).alias("wanted"))


@query("SELECT event_type AS source, 'top 5 ' || CASE WHEN count(*) % 2 = 0 THEN 'with' ELSE 'without' END || ' filter: ' || count(*) || ' hits' AS message FROM events GROUP BY 1")
def status_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _events(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", intent.status_message(F.lit(5), F.col("n") % 2 == 0, F.col("n")).alias("message"))


# ---- without SQL

@query()
def gbt_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a ranker trained on sampled windows' hits, for the hits of every 20th window."""
    asked, blocks = _asked(spark, sf_dir)
    drawn = stage(windows.sample_windows(windows.every_window(blocks, 1, L, H, columns=()), ranker.SAMPLE))
    sampled = encode.encoded(windows.wanted_windows(blocks, drawn, L, H))
    pairs = P.hits_in_series(stage(P.as_queries(sampled, F.concat_ws("|", "source", F.col("window_idx").cast("string")))), blocks, ranker.SAMPLE_K, L, H)
    rows = ranker.training_set(pairs).select("q_key", *fusion.FEATURES, "label").orderBy("q_key", "distance", *fusion.FEATURES[1:])
    model = ranker.train(stage(rows), "q_key")
    weighed = ranker.weighted(P.hits_in_series(asked, blocks, K, L, H), "q_key", model)
    return weighed.select("q_key", "rank_no", "source", "window_idx", r6("weight", "weight"))


@query()
def agent_forecast_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th window asks, each with the question of a conversation."""
    asked, blocks = _asked(spark, sf_dir)
    return P.agent_forecast(None, _questioned(spark, sf_dir, asked), blocks, DEFAULTS.agent_top_k, H, history=L)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_idw_short(spark, sf_dir)
