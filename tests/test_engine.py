"""The forecasting engine's operators against plain versions and fixed results, on small inputs."""

import datetime as dt
import json
import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofold.functions import vectors as V
from echofold.operators import encode, filters, fusion, intent, ranker, report, search, windows
from echofold.plans import forecasting as P
from echofold.schema import Config
from echofold.sources import series as S
from echofold.sources import staging
from echofold.sources.store import Collection
from echofold.streaming.ingest import ingest_stream

START = dt.datetime(2024, 1, 1)


def series_of(spark, n=120, sources=("a", "b"), hours=1):
    rng = np.random.default_rng(3)
    rows = [(s, START + dt.timedelta(hours=hours * i), float(np.round(10 + 5 * math.sin(i / 7 + len(s)) + rng.normal(), 2))) for s in sources for i in range(n)]
    return spark.createDataFrame(rows, "source string, ts timestamp_ntz, value double").repartition(3)


def one(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<double>").alias(k) for k, v in cols.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def points(spark):
    return staging.stage(P.points_of(series_of(spark), 24, 6))


# ---- arrays

def test_fixed_results_of_arrays(spark):
    a = [1.0, 2, 3, 4, 5] * 20
    m = one(spark, V.moments("a"), a=a)
    assert m["mu"] == 3 and abs(m["sigma"] - 1.4142135623730951) < 1e-12 and np.allclose(m["z"][:5], [-1.41421356, -0.70710678, 0, 0.70710678, 1.41421356])
    m = one(spark, V.moments("a"), a=[7.0] * 100)
    assert (m["mu"], m["sigma"], set(m["z"])) == (7, 1, {0.0})
    assert np.allclose(one(spark, V.zscore("a", F.lit(3.0), F.lit(2**0.5)), a=[6.0, 7, 8, 9, 10]), [2.12132034, 2.82842712, 3.53553391, 4.24264069, 4.94974747])
    assert one(spark, V.fit_length("a", 5), a=[1.0, 2, 3]) == [0, 0, 1, 2, 3] and one(spark, V.fit_length("a", 2), a=[1.0, 2, 3, 4]) == [3, 4]
    assert abs(one(spark, V.pearson("a", "b"), a=[1.0, 2, 3, 4], b=[2.0, 4, 5, 9]) - 0.9647638212377321) < 1e-12
    assert one(spark, V.pearson("a", "b"), a=[1.0, 1, 1], b=[2.0, 4, 5]) == 0 and one(spark, V.pearson("a", "b"), a=[], b=[2.0]) == 0
    assert one(spark, V.l2("a"), a=[0.0, 0.0]) == [0, 0] and one(spark, V.l2("a"), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, V.as_list(F.lit(None).cast("array<double>")), a=1) == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=12), st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=12))
def test_arrays_against_numpy(spark, a, b):
    x = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(V.moments("a").alias("m"), V.pearson("a", "b").alias("r"), V.unzscore(V.moments("a")["z"], V.moments("a")["mu"], V.moments("a")["sigma"]).alias("back")).first()
    assert math.isclose(x["m"]["mu"], np.mean(a), abs_tol=1e-9) and np.allclose(x["back"], a, atol=1e-6)
    n = min(len(a), len(b))
    p, q = np.array(a[:n]), np.array(b[:n])
    if p.std() > 1e-6 and q.std() > 1e-6:
        assert math.isclose(x["r"], np.corrcoef(p, q)[0, 1], abs_tol=1e-6)
    elif p.std() < 1e-12 or q.std() < 1e-12:
        assert x["r"] == 0


def test_arrays_are_linear(spark):
    """Four times the length takes well under sixteen times as long, also where only the vector is asked for."""
    def seconds(n, *columns):
        rows = spark.range(0, 600, 1, 4).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i + F.col("id"))).alias("history_x"))
        found = []
        for _ in range(3):
            began = time.time()
            encode.encoded(rows).select(*columns).write.format("noop").mode("overwrite").save()
            found.append(time.time() - began)
        return min(found)

    for columns in (["mu", "sigma", "vector"], ["vector"]):
        assert seconds(2000, *columns) < 9 * max(seconds(500, *columns), 0.1)


# ---- sources

def test_csv(spark, tmp_path):
    (tmp_path / "load_hourly.csv").write_text("date,OT,HUFL\n2016-07-01 00:00:00,1.5,2\n2016-07-01 01:00:00,,3\n")
    (tmp_path / "other.csv").write_text("date,x\n")
    assert S.find_dataset(spark, str(tmp_path), "load_hourly") == f"{tmp_path}/load_hourly.csv" == S.find_dataset(spark, str(tmp_path), "hourly")
    for name in (None, "nothing"):
        with pytest.raises(ValueError):
            S.find_dataset(spark, str(tmp_path), name)
    wide = S.read_csv(spark, f"{tmp_path}/load_hourly.csv")
    assert sorted((r.source, r.ts, r.value) for r in S.to_long(wide).collect() if r.value) == [("HUFL", dt.datetime(2016, 7, 1), 2), ("HUFL", dt.datetime(2016, 7, 1, 1), 3), ("OT", dt.datetime(2016, 7, 1), 1.5)]
    assert {r.source for r in S.to_long(wide, columns=["OT"]).collect()} == {"OT"}
    with pytest.raises(ValueError):
        S.to_long(wide, columns=["nothing"])
    with pytest.raises(ValueError):
        S.read_csv(spark, f"{tmp_path}/load_hourly.csv", "time")


def test_config(tmp_path):
    Config().to_json(str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text())["history"] == 100


# ---- windows

@pytest.mark.parametrize("n,block", [(147, 4000), (148, 4000), (149, 10), (400, 37)])
def test_window_counts_and_blocks(spark, n, block):
    rows = [("s", START + dt.timedelta(hours=i), float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "source string, ts timestamp_ntz, value double")
    out = windows.sliding_windows(df, 100, 48, block=block).collect()
    assert sorted(r.window_idx for r in out) == list(range(max(0, n - 147)))
    for r in out:
        i = r.window_idx
        assert r.history_x == list(map(float, range(i, i + 100))) and r.future_y == list(map(float, range(i + 100, i + 148)))
        assert r.label_ts == START + dt.timedelta(hours=i + 100) and r.last_ts == START + dt.timedelta(hours=i + 147)


def test_windows_with_holes(spark):
    rows = [("s", START + dt.timedelta(hours=i), None if i == 5 else float("nan") if i == 30 else float(i)) for i in range(60)] + [("s", None, 1.0), (None, START, 1.0)]
    df = spark.createDataFrame(rows, "source string, ts timestamp_ntz, value double")
    assert sorted(r.window_idx for r in windows.sliding_windows(df, 6, 4, block=7).collect()) == [i for i in range(51) if not (i <= 5 < i + 10 or i <= 30 < i + 10)]
    assert windows.sliding_windows(df, 6, 4, complete=False).count() == 51
    assert {(r.window_idx, r.batch_no) for r in windows.batches(windows.sliding_windows(df, 6, 4), 20).collect()} == {(i, i // 20) for i in range(51) if not (i <= 5 or i <= 30 < i + 10)}
    assert windows.sliding_windows(df.limit(0), 6, 4).count() == 0


# ---- encoders

def test_check_length(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,)], "h array<double>")
    good, bad = encode.check_length(df, "h", 2)
    assert (good.count(), bad.count()) == (1, 2)
    with pytest.raises(Exception, match="must have 2 values"):
        encode.check_length(df, "h", 2, strict=True)[0].collect()
    with pytest.raises(Exception, match="must have 3 values"):
        P.requests(spark.createDataFrame([("k", [1.0])], "q_key string, history_x array<double>"), 3).collect()


def test_projection_encoder(spark):
    rows = spark.createDataFrame([([1.0, 5.0, 2.0, 8.0],)], "history_x array<double>")
    v = encode.encoded(rows, encode.ProjectionEncoder(4, 16, 1)).first()["vector"]
    matrix = np.random.default_rng(1).standard_normal((16, 4)) / 4
    z = np.array([1.0, 5, 2, 8])
    raw = matrix @ ((z - z.mean()) / z.std())
    assert np.allclose(v, raw / np.linalg.norm(raw))


def test_onnx_encoder_needs_a_model(spark, tmp_path):
    (tmp_path / "bad.onnx").write_bytes(b"no model")
    with pytest.raises(Exception, match="(?i)onnx|protobuf|parse"):
        encode.encoded(spark.createDataFrame([([1.0, 2.0],)], "history_x array<double>"), encode.OnnxEncoder(str(tmp_path / "bad.onnx"))).collect()


# ---- search

def brute_hits(q, p, k, ok=lambda a, b: True, threshold=None):
    out = set()
    for a in q:
        all_ = [(-round(float(np.dot(a[1], b[1])), 9), b[0]) for b in p if ok(a, b) and (threshold is None or np.dot(a[1], b[1]) >= threshold)]
        out |= {(a[0], i, j + 1) for j, (_, i) in enumerate(sorted(all_)[:k])}
    return out


@pytest.mark.parametrize("k,threshold,bytes_,tile", [(1, None, 1 << 20, 1 << 21), (7, None, 400, 64), (40, 0.1, 1 << 20, 200)])
def test_search_against_brute_force(spark, monkeypatch, k, threshold, bytes_, tile):
    """Many points are equal, so that ties are decided by key."""
    monkeypatch.setattr(search, "QUERY_BYTES", bytes_)
    monkeypatch.setattr(search, "TILE", tile)
    rng = np.random.default_rng(k)
    base = rng.normal(size=(25, 4))
    vec = [v / np.linalg.norm(v) for v in base]
    p = [(i, vec[int(rng.integers(0, 25)) if i % 3 else 0]) for i in range(300)]
    df = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in p] + [(999, None, 1)], "id bigint, vector array<double>, label bigint").repartition(5)
    q = p[::20]
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in q], "q_key bigint, q_vector array<double>")
    found = search.search(asked, df, k, "q_key", ["id"], threshold=threshold, exclude="id").collect()
    assert {(r.q_key, r.id, r.rank_no) for r in found} == brute_hits(q, p, k, lambda a, b: a[0] != b[0], threshold)
    some = search.search(asked, df, k, "q_key", ["id"], F.col("label") == 2, threshold, "id", fallback=True).collect()
    for key in {i for i, _ in q}:
        hit = brute_hits([x for x in q if x[0] == key], p, k, lambda a, b: a[0] != b[0] and b[0] % 5 == 2, threshold)
        want = hit or brute_hits([x for x in q if x[0] == key], p, k, lambda a, b: a[0] != b[0], threshold)
        own = [r for r in some if r.q_key == key]
        assert {(r.q_key, r.id, r.rank_no) for r in own} == want and all(r.fallback_used == (not hit) for r in own)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "q_key bigint, q_vector array<double>")
    df = spark.createDataFrame([(1, [1.0])], "id bigint, vector array<double>")
    assert search.search(none, df, 3, "q_key", ["id"]).count() == 0
    assert search.search(df.select(F.col("id").alias("q_key"), F.col("vector").alias("q_vector")), df.limit(0), 3, "q_key", ["id"]).count() == 0
    with pytest.raises(ValueError):
        search.search(none, df, 0, "q_key", ["id"])


def test_hits_are_causal(points):
    asked = P.every(points, 10)
    hits = P.hits_of(asked, points, 8).collect()
    assert hits and all(r.last_ts < r.q_label_ts for r in hits)
    assert {r.rank_no for r in hits} == set(range(1, 9))


# ---- filters and questions

def test_filters(spark):
    df = spark.createDataFrame([(1, 7, True, "a"), (2, None, False, "b"), (3, 6, None, None)], "id int, month int, is_weekend boolean, source string")

    def ids(spec):
        return [r.id for r in df.where(filters.compile_filter(spec)).orderBy("id").collect()]

    assert ids(None) == ids(filters.empty()) == [1, 2, 3]
    assert ids({"must": [{"key": "month", "range": {"gte": 6, "lt": 7}}]}) == [3]
    assert ids({"must_not": [{"key": "month", "match": {"value": 7}}]}) == [2, 3]
    assert ids({"should": [{"key": "source", "match": {"any": ["a", "b"]}}], "must": [{"key": "is_weekend", "match": {"value": False}}]}) == [2]
    assert not filters.is_active(None) and not filters.is_active(filters.empty()) and filters.is_active({"should": [1]})
    for bad in ({"key": "label", "match": {"value": 1}}, {"key": "month"}, {"key": "month", "range": {"near": 1}}, {"key": "month", "match": {"value": "7"}}, {"key": "month", "match": {"value": True}}, {"key": "is_weekend", "match": {"value": 1}}, {"key": "source", "match": {"any": [1]}}):
        with pytest.raises(ValueError):
            filters.compile_filter({"must": [bad]})


def test_repair():
    assert filters.repair('```json\n{"must": [1]}\n```') == {"must": [1], "should": [], "must_not": []}
    assert filters.repair('the filter is {"should": []} as asked') == filters.empty()
    for bad in ("[1]", "no json"):
        with pytest.raises(ValueError):
            filters.repair(bad)


def test_intent():
    assert intent.parse_intent("  ") == filters.empty()
    assert intent.parse_intent("load of OT at weekends", ("OT", "HUFL"))["must"] == [{"key": "is_weekend", "match": {"value": True}}, {"key": "source", "match": {"value": "OT"}}]
    assert intent.parse_intent("anything", model=lambda q: '{"must": [{"key": "hour", "match": {"value": 3}}]}')["must"][0]["key"] == "hour"


# ---- fusion and ranking

def test_weights(spark):
    def weights(scores, column):
        df = spark.createDataFrame([("q", float(s)) for s in scores], "q_key string, score double")
        return [r[0] for r in df.select(column.alias("w"), "score").orderBy(F.col("score").desc()).collect()]

    assert np.allclose(weights([0.9, 0.8], fusion.idw_weight("q_key")), [0.7999999988, 0.2000000012], atol=1e-9)
    assert np.allclose(weights([1.0, 0.9], fusion.idw_weight("q_key")), [0.9999999900000003, 9.99999980000001e-09], atol=1e-12)
    assert np.allclose(weights([0.5, -0.5], fusion.idw_weight("q_key")), [0.9, 0.1], atol=1e-9)
    for x in ([1, 2, 3], [1000, 1001, 1002]):
        assert np.allclose(weights(x, fusion.softmax_weight("q_key", F.col("score"))), [0.66524096, 0.24472847, 0.09003057])


def test_cross_features_of_missing_keys(spark):
    row = spark.createDataFrame([(28.0, 3.0, 30.2, 2.8, 0.9)], "q_mu double, q_sigma double, mu double, sigma double, score double")
    for c, kind in (("month", "int"), ("time_of_day", "string"), ("is_weekend", "boolean")):
        row = row.withColumn(c, F.lit(None).cast(kind)).withColumn(f"q_{c}", F.lit(None).cast(kind))
    x = fusion.cross_features(row).first()
    assert np.allclose([x.abs_mu_diff, x.abs_sigma_diff, x.mu_ratio], [2.2, 0.2, 1.0785713900510217]) and (x.is_same_month, x.is_same_time_of_day, x.is_same_weekday) == (1, 1, 1)


def test_ranker(spark, points, tmp_path):
    pairs = staging.stage(ranker.training_set(P.hits_of(P.every(points, 2), points, 10)))
    model = ranker.train(pairs, "q_key", rounds=5)
    assert set(ranker.importance(model)) == set(fusion.FEATURES)
    e = ranker.evaluate(model, pairs).first()
    assert e.n == pairs.count() and e.rmse < 1
    ranker.save(model, f"{tmp_path}/m", {"rmse": e.rmse})
    with pytest.raises(Exception, match="already exists"):
        ranker.save(model, f"{tmp_path}/m", {})
    ranker.save(model, f"{tmp_path}/m", {"rmse": e.rmse}, overwrite=True)
    about = json.loads(spark.read.text(f"{tmp_path}/m.meta").first()[0])
    assert about["rmse"] == e.rmse and about["features"] == list(fusion.FEATURES)
    asked = P.every(points, 10)
    again = ranker.load(f"{tmp_path}/m")
    hits = P.hits_of(asked, points, 5)
    both = [sorted((r.q_key, r.rank_no, round(r.weight, 9)) for r in ranker.weighted(hits, "q_key", m).collect()) for m in (model, again)]
    assert both[0] == both[1] and all(abs(s - 1) < 1e-6 for s in [r[0] for r in ranker.weighted(hits, "q_key", again).groupBy("q_key").agg(F.sum("weight")).select("sum(weight)").collect()])
    assert ranker.load(f"{tmp_path}/nothing") is None


# ---- collections and answers

def test_collection(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/points", 24)
    assert not c.exists()
    c.create()
    assert c.exists() and c.count() == 0 and c.next_idx("a") == 0
    df = series_of(spark)
    n = P.ingest(c, df, 24, 6)
    assert n == c.count() == 2 * (120 - 29)
    before = {(r.source, r.window_idx): r.mu for r in c.read().collect()}
    assert P.ingest(c, df.where("source = 'a'"), 24, 6) == n // 2
    assert {(r.source, r.window_idx): r.mu for r in c.read().collect()} == before
    c.upsert(c.read().where("source = 'b' and window_idx < 3").withColumn("mu", F.lit(-1.0)))
    assert {(r.source, r.window_idx): r.mu for r in c.read().collect()} == {k: -1.0 if k[0] == "b" and k[1] < 3 else m for k, m in before.items()}
    assert {r.source: r.points for r in c.by_source().collect()} == {"a": n // 2, "b": n // 2}
    assert [P.ingest_sample(c, [1.0, 2.0] * 12, [3.0], 24) for _ in range(2)] == [0, 1]
    bare = c.read().where("source is null").collect()
    assert {r.window_idx for r in bare} == {0, 1} and all(r.month is None and r.future_y == [3.0] for r in bare)
    assert c.read().where(filters.compile_filter({"must_not": [{"key": "month", "match": {"value": 1}}]})).count() == 2
    for bad in (([1.0], [2.0]), ([1.0] * 24, [])):
        with pytest.raises(ValueError):
            P.ingest_sample(c, *bad, 24)
    with pytest.raises(ValueError):
        c.upsert(c.read().withColumn("vector", F.array(F.lit(1.0))))
    assert c.info().first()["points"] == n + 2 and c.info().first()["vector_width"] == 24
    c.create()
    with pytest.raises(ValueError):
        Collection(spark, f"{tmp_path}/points", 9).create()
    c.drop()
    assert not c.exists()


def test_ingest_stream(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/points", 24)
    c.create()
    df = series_of(spark)
    df.where("ts < '2024-01-03'").write.parquet(f"{tmp_path}/in")
    for part in (None, df.where("ts >= '2024-01-03'")):
        if part is not None:
            part.write.mode("append").parquet(f"{tmp_path}/in")
        ingest_stream(spark, f"{tmp_path}/in", c, 24, 6, f"{tmp_path}/state").awaitTermination()
    assert c.count() == 2 * (120 - 29)


def test_forecast_of_a_request(spark, points):
    asked = P.requests(spark.createDataFrame([("r", [float(i % 7) for i in range(24)])], "q_key string, history_x array<double>"), 24)
    out = P.forecast(asked, points, 3, 6).orderBy("step").collect()
    h = np.array([float(i % 7) for i in range(24)])
    z = (h - h.mean()) / h.std()
    best = sorted(points.collect(), key=lambda r: (-round(float(np.dot(r.vector, z / np.linalg.norm(z))), 9), r.source, r.window_idx))[:3]
    d = np.array([1 - float(np.dot(r.vector, z / np.linalg.norm(z))) for r in best])
    w = 1 / (d**2 + 1e-10) / (1 / (d**2 + 1e-10)).sum()
    want = sum(wi * (np.array(r.future_y) - r.mu) / r.sigma for wi, r in zip(w, best, strict=True)) * h.std() + h.mean()
    assert np.allclose([r.y_hat for r in out], want)


def test_agent_forecast(points):
    asked = P.last_windows(points)
    out = {r.q_key: json.loads(r.answer) for r in P.agent_forecast("workday load of a", asked, points, 4, 6, sources=("a", "b"), history=24).collect()}
    assert set(out) == {"a", "b"}
    for x in out.values():
        assert len(x["values"]) == 6 and len(x["chunks"]) == 4 and not x["fallback_used"] and "with filter: 4 hits" in x["message"]
        assert all(c["source"] == "a" and not c["is_weekend"] for c in x["chunks"])
        assert all(f"## {h}" in x["report"] for h in ("Question", "Forecast", "Similar windows", "Advice"))
    fell = json.loads(P.agent_forecast("late night in july", asked, points, 4, 6).first().answer)
    assert fell["fallback_used"] and "without filter" in fell["message"]
    for bad in (("x", 4), ("x" * 501, 4), ("a question", 0), ("a question", 101)):
        with pytest.raises(ValueError):
            P.agent_forecast(bad[0], asked, points, bad[1], 6)
    with pytest.raises(Exception, match="must have 23 values"):
        P.agent_forecast("a question", asked, points, 4, 6, history=23)


def test_agent_forecast_of_own_questions(points):
    asked = P.last_windows(points).withColumn("q_question", F.when(F.col("q_key") == "a", "workday load of b").otherwise("late night in july"))
    out = {r.q_key: json.loads(r.answer) for r in P.agent_forecast(None, asked, points, 4, 6, sources=("a", "b")).collect()}
    assert json.loads(out["a"]["filter"]) == intent.parse_intent("workday load of b", ("a", "b")) and not out["a"]["fallback_used"]
    assert {c["source"] for c in out["a"]["chunks"]} == {"b"} and "workday load of b" in out["a"]["report"]
    assert out["b"]["fallback_used"] and "without filter" in out["b"]["message"] and "late night" in out["b"]["report"]
    with pytest.raises(Exception, match="2 to 500 characters"):
        P.agent_forecast(None, asked.withColumn("q_question", F.lit("x")), points, 4, 6).collect()


def test_agent_forecast_without_hits(points):
    asked = P.last_windows(points)
    out = P.agent_forecast("a question", asked, points.where("false"), 4, 6).collect()
    mu = {r.q_key: r.q_mu for r in asked.collect()}
    assert {r.q_key for r in out} == set(mu)
    for r in out:
        x = json.loads(r.answer)
        assert np.allclose(x["values"], round(mu[r.q_key], 4), atol=1e-4) and "no similar window" in x["message"] and "## Similar windows\n- none" in x["report"]


def test_backtest(spark):
    q = spark.createDataFrame([("q", [1.0, 2.0, 4.0])], "q_key string, q_future_y array<double>")
    guess = spark.createDataFrame([("q", i, y) for i, y in enumerate([1.0, 3.0, 2.0])], "q_key string, step int, y_hat double")
    r = P.backtest(q, guess).first()
    assert r.n == 3 and r.mae == 1 and abs(r.rmse - (5 / 3) ** 0.5) < 1e-12


def test_trend(spark):
    df = spark.createDataFrame([(k, i, float(y)) for k, ys in {"up": range(6), "down": range(6, 0, -1), "flat": [1, 2, 1, 2, 1, 2]}.items() for i, y in enumerate(ys)], "q_key string, step int, y_hat double")
    assert {r.q_key: r.trend for r in report.summary(df, "q_key").collect()} == {"up": "rising", "down": "falling", "flat": "oscillating"}


# ---- plans

def test_events_are_scanned_once(spark, sf_dir):
    pts = P.points_of(S.events_series(spark, sf_dir), 24, 6)
    assert pts._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2
    asked = P.every(staging.stage(pts), 20)
    assert "Relation [event" not in P.hits_of(asked, asked.selectExpr(*[f"q_{c} as {c}" for c in pts.columns]), 3)._jdf.queryExecution().optimizedPlan().toString()


def test_filter_reaches_the_scan(spark, points):
    hits = P.hits_of(P.every(points, 20), points, 3, F.col("month") == 1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(month,1)" in plan


# ---- slabs and bands

def test_upserts_touch_their_slabs_only(spark, tmp_path):
    import glob
    import os

    def files():
        return {p: (os.path.getmtime(p), os.path.getsize(p)) for p in glob.glob(f"{tmp_path}/points/**/*.parquet", recursive=True)}

    c = Collection(spark, f"{tmp_path}/points", 24, slab=20)
    c.create()
    P.ingest(c, series_of(spark), 24, 6)
    before, rows = files(), c.count()
    assert len({os.path.dirname(p) for p in before}) >= 2 * 5
    c.upsert(c.read().where("source = 'b' and window_idx between 25 and 30").withColumn("mu", F.lit(-1.0)))
    after = files()
    assert {os.path.dirname(p).split("points/")[1] for p in before.keys() ^ after.keys()} == {"source=b/slab=1"}
    assert c.count() == rows and c.read().where("mu = -1").count() == 6
    idx = P.ingest_sample(c, [1.0, 2.0] * 12, [3.0], 24)
    assert all(files()[p] == v for p, v in after.items()) and idx == 0 and c.count() == rows + 1
    assert "slab" not in c.read().columns


def test_upserts_neither_move_nor_rewrite_what_they_leave(spark, tmp_path, monkeypatch):
    """A collection's first rows are written as they are made; upserts add files, until their number is reached."""
    import glob

    from echofold.sources import store

    def files():
        return set(glob.glob(f"{tmp_path}/points/**/*.parquet", recursive=True))

    monkeypatch.setattr(store, "CHANGES", 3)
    c = Collection(spark, f"{tmp_path}/points", 24, slab=20)
    c.create()
    staged, stage = [], store.stage
    monkeypatch.setattr(store, "stage", lambda df: (staged.append(df), stage(df))[1])
    n = P.ingest(c, series_of(spark), 24, 6)
    assert not staged and c.count() == n  # no copy of all windows
    expected = {(r.source, r.window_idx): r.mu for r in c.read().collect()}
    for i in range(5):
        before = files()
        rows = c.read().where(F.col("window_idx").between(i, 30 + i)).withColumn("mu", F.lit(float(-i)))
        assert c.upsert(rows) == 2 * 31
        assert before <= files() or i == 3
        expected |= {k: float(-i) for k in expected if i <= k[1] <= 30 + i}
        assert {(r.source, r.window_idx): r.mu for r in c.read().collect()} == expected and c.count() == n
    assert c._changes() == [1, 2] and c.info().first()["vector_width"] == 24


def test_filters_skip_row_groups(spark, tmp_path, monkeypatch):
    """Rows read by a search under a filter of time, against all rows."""
    from echofold.sources import store

    monkeypatch.setattr(store, "GROUP_BYTES", 32 << 10)
    c = Collection(spark, f"{tmp_path}/points", 24)
    c.create()
    P.ingest(c, series_of(spark, 1500), 24, 6)
    kept = c.read().where(filters.compile_filter({"must": [{"key": "month", "match": {"value": 2}}, {"key": "hour", "range": {"lt": 2}}]}))
    expected = [r for r in c.read().collect() if r.month == 2 and r.hour < 2]
    assert sorted(r.window_idx for r in kept.collect()) == sorted(r.window_idx for r in expected)
    execution = kept._jdf.queryExecution()

    def scanned(plan):
        found = [plan] if "Scan" in plan.nodeName() else []
        children = plan.children()
        for i in range(children.size()):
            found += scanned(children.apply(i))
        return found

    read = scanned(execution.executedPlan())[0].metrics().get("numOutputRows").get().value()
    assert len(expected) <= read < 0.5 * c.count()


def test_latest_does_not_depend_on_order(spark):
    from echofold.sources.store import latest

    rows = [("a", 1, None, float(i)) for i in range(50)]
    found = {latest(spark.createDataFrame(rows[::s], "source string, window_idx int, label_ts timestamp_ntz, mu double").repartition(5), ("source", "window_idx")).first().mu for s in (1, -1)}
    assert found == {49.0}


def test_bands(spark):
    hits = spark.createDataFrame(
        [("q", 10.0, 2.0, 1, 0.5, [1.0, 5.0], 0.0, 1.0), ("q", 10.0, 2.0, 2, 0.3, [2.0], 0.0, 1.0), ("q", 10.0, 2.0, 3, 0.2, [3.0, 4.0], 0.0, 1.0), ("none", 0.0, 1.0, 1, 1.0, [], 0.0, 1.0)],
        "q_key string, q_mu double, q_sigma double, rank_no int, weight double, future_y array<double>, mu double, sigma double",
    )
    got = {(r.q_key, r.step): (r.lo, r.mid, r.hi) for r in fusion.bands(hits, "q_key", 2).collect()}
    assert got == {("q", 0): (12.0, 12.0, 16.0), ("q", 1): (18.0, 20.0, 20.0)}
    a = fusion.agreement(fusion.bands(hits, "q_key", 2), "q_key").first()
    assert (a.width, a.movement) == (3.0, 4.0)


def test_learned_encoder(spark, points):
    """Equal to NumPy, and near to the full vector's neighbours."""
    rows = series_of(spark, 400)
    cut = staging.stage(windows.sliding_windows(rows, 24, 6))
    own = encode.LearnedEncoder.from_json(encode.LearnedEncoder.fit(cut, 32, 6, 2).to_json())
    h = np.array([r.history_x for r in cut.collect()])
    z = (h - h.mean(1, keepdims=True)) / h.std(1, keepdims=True)
    pooled = np.c_[np.zeros((len(z), 8)), z].reshape(len(z), 16, 2).mean(2)
    values, vectors = np.linalg.eigh(pooled.T @ pooled)
    assert np.allclose(np.abs(own.matrix), np.abs(vectors[:, ::-1][:, :6].T), atol=1e-6) and (own.matrix.max(1) >= -own.matrix.min(1)).all()
    found = {(r.source, r.window_idx): r.vector for r in encode.encoded(cut, own).collect()}
    assert all(len(v) == 6 and abs(np.linalg.norm(v) - 1) < 1e-9 for v in found.values())
    kept = cut.collect()
    x = np.array([found[r.source, r.window_idx] for r in kept])
    full = z / np.linalg.norm(z, axis=1, keepdims=True)
    near = lambda v: np.argsort(-(v @ v.T), axis=1)[:, 1:11]
    whole = encode.LearnedEncoder.fit(cut, 24, 24, 1)
    found = {(r.source, r.window_idx): r.vector for r in encode.encoded(cut, whole).collect()}
    overlaps = [np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near(v), near(full), strict=True)]) for v in (x, np.array([found[r.source, r.window_idx] for r in kept]))]
    assert overlaps[0] > 0.3 and overlaps[1] > 0.99, overlaps  # chance would give 0.013
    flat = spark.createDataFrame([([1.0] * 24,), ([1.0, 2.0, 4.0],)], "history_x array<double>")
    assert [round(sum(v * v for v in r.vector), 6) for r in encode.encoded(flat, own).collect()] == [0, 1]
    for bad in ((30, 6, 4), (32, 17, 2), (32, 0, 2)):
        with pytest.raises(ValueError):
            encode.LearnedEncoder.fit(cut, *bad)


def test_forecasts_leave_their_result_only(spark, points):
    import os

    def folders():
        return set(os.listdir(staging.shared_dir(spark).removeprefix("file:")))

    asked = staging.stage(P.every(points, 20))
    before = folders()
    out = P.forecast(asked, points, 3, 6)
    assert len(folders() - before) == 1 and out.count() == 6 * asked.count()
    staging.discard(out)
    P.agent_forecast("workday load", asked, points, 3, 6).count()
    assert len(folders() - before) == 1
    with pytest.raises(Exception, match="dimensions"):
        P.forecast(asked.withColumn("q_vector", F.slice("q_vector", 1, 3)), points, 3, 6)
    assert len(folders() - before) == 1


@pytest.mark.parametrize("at_once", [1, 3, 500])
def test_bands_are_those_of_sorted_steps_without_a_row_for_each(spark, monkeypatch, at_once):
    """Ragged and empty futures, equal values and one hit alone, against plain sorting; a hit's steps aren't rows of a window."""
    monkeypatch.setattr(fusion, "AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    rows = []
    for q in range(11):
        n = 1 + q % 5
        w = rng.random(n)
        rows += [(f"q{q}", float(q), 1.0 + q, r + 1, float(w[r] / w.sum()), [] if (q + r) % 7 == 3 else [float(x) for x in rng.integers(0, 3, 4 + (q + r) % 4)], 1.0, 2.0) for r in range(n)]
    hits = spark.createDataFrame(rows, "q_key string, q_mu double, q_sigma double, rank_no int, weight double, future_y array<double>, mu double, sigma double").repartition(3)
    want = []
    for q in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == q]
        for step in range(6):
            have = sorted(((r[5][step] - r[6]) / r[7], r[3], r[4]) for r in own if len(r[5]) > step)
            if have:
                upto = np.cumsum([h[2] for h in have])
                want.append((q, step, *(round(next(h[0] for h, u in zip(have, upto, strict=True) if u / upto[-1] >= p - 1e-9) * own[0][2] + own[0][1], 9) for p in (0.1, 0.5, 0.9))))
    b = fusion.bands(hits, "q_key", 6)
    assert sorted((r.q_key, r.step, round(r.lo, 9), round(r.mid, 9), round(r.hi, 9)) for r in b.collect()) == sorted(want)
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
