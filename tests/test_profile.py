"""Search in the series, and places by ranges, against plain versions."""

import datetime as dt
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofold.operators import encode, profile, windows
from echofold.plans import forecasting as P
from echofold.sources.staging import stage

START = dt.datetime(2024, 1, 1)


def series(spark, values, seconds=3600):
    rows = [(s, START + dt.timedelta(seconds=seconds * i), i, v if v is None else float(v)) for s, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "source string, ts timestamp_ntz, tie bigint, value double").repartition(4)


def shapes(n=400):
    rng = np.random.default_rng(5)
    walk = np.cumsum(rng.normal(size=n))
    holes = [None if i in (50, 200) else float("nan") if i == 120 else float(x) for i, x in enumerate(np.sin(np.arange(n) / 5))]
    quiet = np.r_[rng.normal(size=n // 2) * 1e6, 3 + rng.normal(size=n - n // 2) * 1e-5]
    return {"walk": walk, "holes": holes, "quiet": quiet, "flat": [7.0] * n, "steps": [i % 12 for i in range(n)], "short": [1.0, 2.0]}


@pytest.mark.parametrize("tile", [1, 30, 1000])
def test_products_in_tiles(monkeypatch, tile):
    """What may be among the best is found whatever is multiplied at once, gaps and late windows left out."""
    monkeypatch.setattr(profile, "TILE", tile)
    rng = np.random.default_rng(9)
    values = rng.normal(size=400)
    values[77] = np.nan
    stretch, vectors, open_ = profile.Stretch(values, 371, 24, 30), profile.unit(rng.normal(size=(9, 24))), np.arange(0, 369, 41)
    query, window, score = profile.best(stretch, vectors, open_, 2, np.full(9, -np.inf), 400)
    exact = profile.unit(np.lib.stride_tricks.sliding_window_view(values, 24)) @ vectors.T
    whole = np.array([not np.isnan(values[i : i + 30]).any() for i in range(371)])
    for q in range(9):
        may = np.flatnonzero(whole & (np.arange(371) < open_[q]))
        assert set(may[np.argsort(-exact[may, q])[:2]]) <= set(window[query == q]) <= set(may)
    assert np.allclose(score, exact[window, query], atol=1e-12)


@pytest.mark.parametrize("block,pack,fourier", [(4000, 256, 400), (37, 5, 400), (90, 7, 1)])
def test_hits_in_series_are_those_of_vectors(spark, monkeypatch, block, pack, fourier):
    """Periodic and flat series give many equal scores, which go by key; a quiet half after a loud one tests the prefix sums."""
    monkeypatch.setattr(profile.packs, "__defaults__", (None, pack))
    monkeypatch.setattr(profile.nearest, "__defaults__", (*profile.nearest.__defaults__[:-1], fourier))
    monkeypatch.setattr(windows.wanted_windows, "__defaults__", (block,))
    history, future, k = 24, 6, 7
    df = series(spark, shapes())
    blocks = stage(windows.series_blocks(df, history, future, tie="tie", block=block))
    points = stage(P.points_of(df, history, future, tie="tie"))
    asked = stage(P.asked_windows(blocks, 10, history, future))
    assert asked.count() == P.every(points, 10).count()
    columns = ["q_key", "rank_no", "source", "window_idx", "label_ts", "last_ts", "month", "hour", "is_weekend", "time_of_day", "future_y", "q_future_y"]
    told = lambda d: sorted((*[str(r[c]) for c in columns], round(r["score"], 7), round(r["mu"], 6), round(r["sigma"], 6)) for r in d.collect())
    assert told(P.hits_in_series(asked, blocks, k, history, future)) == told(P.hits_of(P.every(points, 10), points, k))
    above = {(r.q_key, r.source, r.window_idx) for r in P.hits_in_series(asked, blocks, k, history, future, threshold=0.9).collect()}
    assert above == {(r.q_key, r.source, r.window_idx) for r in P.hits_of(P.every(points, 10), points, k, threshold=0.9).collect()}


def test_windows_far_from_their_blocks_mean(spark):
    """Levels far apart with little movement around them: single precision must not lose hits that lie close together."""
    rng = np.random.default_rng(8)
    level = np.repeat(rng.normal(size=40) * 1000, 50)
    df = series(spark, {"a": level + np.repeat(rng.normal(size=500), 4), "b": level[::-1] + np.repeat(rng.normal(size=500), 4)})
    blocks = stage(windows.series_blocks(df, 24, 6, tie="tie"))
    points = stage(P.points_of(df, 24, 6, tie="tie"))
    asked = stage(P.asked_windows(blocks, 3, 24, 6))
    told = lambda d: sorted((r.q_key, r.rank_no, r.source, r.window_idx, round(r.score, 8)) for r in d.collect())
    assert told(P.hits_in_series(asked, blocks, 5, 24, 6)) == told(P.hits_of(P.every(points, 3), points, 5))


def test_equal_scores_end_a_query(spark):
    """A query whose hits all have the highest score asks no later block; the earlier windows are its hits."""
    values = np.tile([3.0, 1.0, 4.0, 1.0, 5.0, 9.0], 70)
    vectors = profile.unit(np.lib.stride_tricks.sliding_window_view(values, 24)[:1])
    stretch = profile.Stretch(values, 390, 24, 30)
    found = profile.Leaders(vectors, 3, None)
    found.take(0, *profile.best(stretch, vectors, np.array([390]), 3, found.least, 400))
    assert found.done.all() and found.window.tolist() == [0, 6, 12]
    found.take(1, *profile.best(stretch, vectors, np.array([390]), 3, found.least, 400))
    assert found.block.tolist() == [0, 0, 0]
    df = series(spark, {"a": values, "b": values})
    blocks = stage(windows.series_blocks(df, 24, 6, tie="tie", block=40))
    asked = stage(P.asked_windows(blocks, 10, 24, 6))
    points = stage(P.points_of(df, 24, 6, tie="tie"))
    told = lambda d: sorted((r.q_key, r.rank_no, r.source, r.window_idx) for r in d.collect())
    hits = profile.nearest(asked, blocks, 5, 24, 6)
    assert told(hits) == told(P.hits_of(P.every(points, 10), points, 5))


def test_filters_that_let_nothing_pass_are_left_out(monkeypatch):
    """Only queries whose filter lets a window pass are multiplied."""
    rng = np.random.default_rng(4)
    stretch = profile.Stretch(rng.normal(size=300), 270, 24, 30)
    vectors = profile.unit(rng.normal(size=(6, 24)))
    asked = []
    scores = stretch.scores
    monkeypatch.setattr(stretch, "scores", lambda v, *a: (asked.append(len(v)), scores(v, *a))[1])
    passing = np.zeros((3, 270), bool)
    passing[0], passing[1, 200:] = True, True
    open_ = np.array([270, 270, 270, 100, 100, 100])
    query, window, _ = profile.best(stretch, vectors, open_, 2, np.full(6, -np.inf), 400, passing, np.array([0, 1, 2, 0, 1, 2]))
    assert asked == [3] and set(query) == {0, 1, 3} and window[query == 1].min() >= 200 and window[query == 3].max() < 100


def test_infinite_values_have_no_score(spark):
    values = np.random.default_rng(6).normal(size=300)
    values[150] = np.inf
    df = series(spark, {"a": values})
    for fourier in (400, 1):
        blocks = stage(windows.series_blocks(df, 24, 6, tie="tie"))
        asked = stage(P.asked_windows(blocks, 10, 24, 6))
        found = profile.nearest(asked, blocks, 3, 24, 6, fourier=fourier).collect()
        assert {r.q_key for r in found} >= {f"a|{i}" for i in range(60, 120, 10)} and not any(126 < r.window_idx <= 150 for r in found)


def test_requests_in_series_and_forecasts(spark):
    df = series(spark, shapes())
    blocks = stage(windows.series_blocks(df, 24, 6, tie="tie"))
    points = stage(P.points_of(df, 24, 6, tie="tie"))
    asked = P.requests(spark.createDataFrame([("r", [float(i % 7) for i in range(24)]), ("flat", [1.0] * 24)], "q_key string, history_x array<double>"), 24)
    told = lambda d: sorted((r.q_key, r.step, round(r.y_hat, 6)) for r in d.collect())
    assert told(P.forecast_in_series(asked, blocks, 3, 24, 6)) == told(P.forecast(asked, points, 3, 6))
    assert P.hits_in_series(asked.limit(0), blocks, 3, 24, 6).count() == 0 and P.hits_in_series(asked, stage(blocks.limit(0)), 3, 24, 6).count() == 0
    with pytest.raises(Exception, match="must have 24 dimensions"):
        P.hits_in_series(asked.withColumn("q_vector", F.slice("q_vector", 1, 23)), blocks, 3, 24, 6).collect()
    with pytest.raises(ValueError):
        P.hits_in_series(asked, blocks, 0, 24, 6)


def test_series_blocks_hold_each_value_about_once(spark):
    df = series(spark, {"s": range(1000)})
    blocks = windows.series_blocks(df, 20, 5, tie="tie", block=100).collect()
    assert sum(len(r["values"]) for r in blocks) <= 1000 + 24 * len(blocks) and sum(r["size"] for r in blocks) == 976
    for r in blocks:
        assert r["values"] == list(map(float, range(r["first"], r["first"] + len(r["values"]))))


@pytest.mark.parametrize("cut", [7, 1000])
def test_windows_cut_from_blocks_are_the_sliding_ones(spark, monkeypatch, cut):
    """Also their keys alone; and no slice() of a block's array for each window."""
    monkeypatch.setattr(windows, "CUT", cut)
    df = series(spark, shapes() | {"gap": [None] * 40, "short": [1.0] * 30})
    blocks = stage(windows.series_blocks(df, 24, 6, tie="tie", block=50))
    told = lambda d: sorted((r.source, r.window_idx, r.label_ts, r.last_ts, tuple(r.history_x), tuple(r.future_y)) for r in d.collect())
    want = told(windows.sliding_windows(df, 24, 6, tie="tie"))
    found = windows.every_window(blocks, 1, 24, 6)
    assert told(found) == want and told(windows.every_window(blocks, 7, 24, 6)) == [w for w in want if w[1] % 7 == 0]
    keys = windows.every_window(blocks, 1, 24, 6, columns=())
    assert keys.columns == ["source", "window_idx"] and sorted(map(tuple, keys.collect())) == [w[:2] for w in want]
    twice = spark.createDataFrame([w[:2] for w in want[::9]] * 2 + [("walk", 100_000), ("none", 3)], "source string, window_idx bigint")
    assert told(windows.wanted_windows(blocks, twice, 24, 6, block=50)) == want[::9]
    own = encode.encoded(windows.sliding_windows(df, 24, 6, tie="tie")).select("source", "window_idx", "mu", "sigma")
    moments = windows.every_window(blocks, 1, 24, 6, columns=("mu", "sigma"))
    assert np.allclose([r[2:] for r in sorted(map(tuple, moments.collect()))], [r[2:] for r in sorted(map(tuple, own.collect()))], rtol=1e-9, atol=1e-12)
    assert "slice(" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("dense", [False, True])
def test_places_are_those_of_row_number(spark, dense):
    """dense: all rows of a source in one second."""
    rng = np.random.default_rng(2)
    rows = [("ab"[int(i % 5 == 0)], START + dt.timedelta(seconds=0 if dense else int(rng.integers(0, 300))), i, float(rng.integers(0, 9))) for i in range(3000)] + [("a", None, 1, 1.0), (None, START, 1, 1.0)]
    df = spark.createDataFrame(rows, "source string, ts timestamp_ntz, tie bigint, value double").repartition(4)
    placed = windows.positions(df, "tie")
    expected = {}
    for s in "ab":
        own = sorted((t, tie) for x, t, tie, _ in rows if x == s and t is not None)
        expected |= {(s, tie): i for i, (_, tie) in enumerate(own)}
    assert {(r.source, r.tie): r.window_idx for r in placed.collect()} == expected
    parts = placed.where("source = 'a'").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 1500


@pytest.mark.parametrize("fallback", [False, True])
def test_filters_of_queries_in_series(spark, fallback):
    specs = [
        None, '{"must": [{"key": "is_weekend", "match": {"value": true}}]}', '{"must": [{"key": "source", "match": {"any": ["walk", "steps"]}}, {"key": "mu", "range": {"gte": 0}}]}', '{"must": [{"key": "month", "match": {"value": 7}}]}',
        '{"should": [{"key": "hour", "match": {"value": 3}}, {"key": "time_of_day", "match": {"value": "evening"}}], "must_not": [{"key": "sigma", "range": {"lt": 0.8}}]}',
    ]
    df = series(spark, shapes())
    blocks = stage(windows.series_blocks(df, 24, 6, tie="tie", block=90))
    points = stage(P.points_of(df, 24, 6, tie="tie"))
    spec = F.element_at(F.array(*(F.lit(s) for s in specs)), (F.floor(F.col("q_window_idx") / 10) % len(specs) + 1).cast("int"))
    asked = stage(P.every(points, 10).withColumn("spec", spec))
    columns = ["q_key", "rank_no", "source", "window_idx", "label_ts"] + ["fallback_used"] * fallback
    told = lambda d: sorted((*[str(r[c]) for c in columns], round(r["score"], 7)) for r in d.collect())
    with pytest.MonkeyPatch.context() as m:
        m.setattr(windows.wanted_windows, "__defaults__", (90,))
        found = told(P.hits_in_series(asked, blocks, 4, 24, 6, spec="spec", fallback=fallback))
    assert found == told(P.hits_of(asked, points, 4, spec="spec", fallback=fallback))
    assert not fallback or {x[-2] for x in found} == {"True", "False"}


def test_limits_of_k(spark):
    df = spark.createDataFrame([("q", [0.0])], "q_key string, q_vector array<double>")
    for k in (0, 101, 1_000_000):
        with pytest.raises(ValueError, match="1 to 100"):
            P.forecast(df, df, k)
        with pytest.raises(ValueError, match="1 to 100"):
            P.forecast_in_series(df, df, k)


def test_a_task_gives_the_best_of_all_its_blocks(spark, monkeypatch):
    """What is shuffled goes with queries and k, not with blocks or partitions."""
    df = series(spark, shapes())
    blocks = stage(windows.series_blocks(df, 24, 6, tie="tie", block=10))
    asked = stage(P.asked_windows(blocks, 10, 24, 6))
    want = sorted(tuple(r) for r in profile.nearest(asked, blocks, 3, 24, 6).select("q_key", "source", "window_idx", "rank_no").collect())
    monkeypatch.setattr(profile, "top_k", lambda found, *_: found)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = stage(profile.nearest(asked, blocks, 3, 24, 6))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(want) <= found.count() <= 3 * 6 * asked.count()  # a pack meets six groups of blocks at 64 partitions
    monkeypatch.undo()
    monkeypatch.setattr(profile, "HELD", 100)  # more rows than a task may hold: more groups of blocks, the same hits
    assert sorted(tuple(r) for r in profile.nearest(asked, blocks, 3, 24, 6).select("q_key", "source", "window_idx", "rank_no").collect()) == want


def test_agent_answers_from_the_series(spark):
    df = series(spark, shapes(200))
    blocks, points = stage(windows.series_blocks(df, 24, 6, tie="tie")), stage(P.points_of(df, 24, 6, tie="tie"))
    asked = stage(P.asked_windows(blocks, 40, 24, 6).withColumn("q_question", F.when(F.col("q_window_idx") == 80, "load in July").otherwise("late night load")))
    told = [{r.q_key: json.loads(r.answer) for r in P.agent_forecast(None, asked, x, 3, 6, history=24).collect()} for x in (blocks, points)]
    own = [{k: (a["filter"], a["fallback_used"], a["message"], [(c["source"], c["window_idx"]) for c in a.get("chunks") or []]) for k, a in t.items()} for t in told]
    assert own[0] == own[1] and any(a["fallback_used"] for a in told[0].values())


def test_packs_hold_neighbours_histories(spark, monkeypatch):
    """Queries are sent as histories in the order of their places, which compress; hits are those of their vectors."""
    rng = np.random.default_rng(3)
    df = series(spark, {s: rng.normal(size=3000) for s in ("a", "b")})
    blocks = stage(windows.series_blocks(df, 100, 48, tie="tie"))
    asked = stage(P.asked_windows(blocks, 20, 100, 48))
    files = [stage(profile.packs(q, "q_key", "q_label_ts")) for q in (asked, asked.drop("q_vector"), asked.drop("q_history_x"))]
    size = [sum(p.stat().st_size for p in Path(x.staged_at).glob("*.parquet")) for x in files]
    assert max(size[:2]) < size[2] / 2
    for held in files[0].select("vectors").collect():
        x = np.array(held["vectors"]).reshape(-1, 100)
        assert (x[:-1, 20:] == x[1:, :80]).all(1).sum() >= len(x) - 2  # two series, so one break
    told = lambda q: sorted((r.q_key, r.source, r.window_idx, r.rank_no) for r in profile.nearest(q, blocks, 5, 100, 48).collect())
    assert told(asked) == told(asked.drop("q_vector")) == told(asked.drop("q_history_x"))


def test_search_in_turns_gives_the_same_hits_and_clears_up(spark, sf_dir, monkeypatch):
    import os

    from echofold.plans import catalogue

    asked, blocks = catalogue._asked(spark, sf_dir, 24, 6)
    packed, found = [], []
    staging = profile.stage
    monkeypatch.setattr(profile, "stage", lambda df: (found.append(staging(df)), found[-1])[1])
    rows = []
    for part in (1 << 30, 1):
        monkeypatch.setattr(profile, "PART", part)
        found.clear()
        rows.append(sorted(map(tuple, profile.nearest(asked, blocks, 3, 24, 6).select("q_key", "source", "window_idx", "rank_no", "score").collect())))
        packed.append([os.path.exists(x.staged_at) for x in found])
    assert rows[0] and rows[0] == rows[1]
    assert packed[0] == [False, True]  # packs go when they are no longer needed
    assert len(packed[1]) > 3 and not any(packed[1][:-1]) and packed[1][-1]
