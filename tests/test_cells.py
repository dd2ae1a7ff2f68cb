"""The metric index against full scans, and filters of single queries against columns."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofold.operators import cells, filters, intent, search
from echofold.sources.staging import stage

SPECS = [
    None, "", json.dumps({"must": [{"key": "month", "match": {"value": 3}}]}), json.dumps({"must_not": [{"key": "month", "range": {"gte": 2, "lt": 9}}]}),
    json.dumps({"should": [{"key": "time_of_day", "match": {"value": "night"}}, {"key": "hour", "match": {"any": [1, 5]}}], "must": [{"key": "is_weekend", "match": {"value": False}}]}),
    json.dumps({"must": [{"key": "mu", "range": {"gt": 0.2, "lte": 0.9}}], "must_not": [{"key": "source", "match": {"value": "a"}}]}), json.dumps({"must": [{"key": "month", "match": {"any": []}}]}),
    json.dumps({"must": [{"key": "sigma", "range": {"gte": 1}}]}), json.dumps({"must": [{"key": "month", "match": {"value": 77}}]}),
]


def points(spark, n=600, clusters=12):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(clusters, 16))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, 16)) * 0.2
    x[n // 2 : n // 2 + n // 5] = x[0]  # a fifth is one vector
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    x[5::50] = 0
    start = dt.datetime(2024, 1, 1)
    rows = [
        (i, v.tolist(), None if i % 11 == 0 else i % 10, i % 24, None if i % 13 == 0 else i % 7 > 4, "night" if i % 3 else None, "ab"[i % 2], i / n, float("nan") if i % 17 == 0 else i % 3 * 1.0, start + dt.timedelta(hours=i))
        for i, v in enumerate(x)
    ]
    schema = "id bigint, vector array<double>, month int, hour int, is_weekend boolean, time_of_day string, source string, mu double, sigma double, ts timestamp_ntz"
    return spark.createDataFrame([*rows, (n, None, 1, 1, None, None, "a", 1.0, 1.0, start)], schema).repartition(4)


def told(hits, more=()):
    return sorted((r["q_key"], r["rank_no"], r["id"], round(r["score"], 8), *[r[c] for c in more]) for r in hits.collect())


@pytest.mark.parametrize("k,threshold,before,block,pack", [(5, None, False, 2048, 256), (3, 0.3, False, 7, 4), (4, None, True, 50, 30), (300, None, False, 64, 9)])
def test_cells_against_a_scan(spark, monkeypatch, k, threshold, before, block, pack):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "PACK", pack)
    p = stage(points(spark))
    asked = p.where("id % 7 = 0").select(F.col("id").alias("q_key"), F.col("vector").alias("q_vector"), F.col("ts").alias("q_ts"), F.lit(1).alias("cell"))
    given = {"threshold": threshold, "exclude": "id", "before": ("ts", "q_ts") if before else None}
    scanned = search.search(asked, p, k, "q_key", ["id"], **given)
    assert told(cells.search(asked, cells.build(p, ["id"]), k, "q_key", **given), ["ts", "q_ts"]) == told(scanned, ["ts", "q_ts"])


@pytest.mark.parametrize("fallback", [False, True])
def test_filters_query_by_query(spark, fallback):
    """Each query's hits are those of a search with its filter as a column, by the scan and by the index."""
    p = stage(points(spark, 300))
    spec = F.element_at(F.array(*(F.lit(s) for s in SPECS)), (F.col("id") % len(SPECS) + 1).cast("int"))
    asked = stage(p.where("id % 4 = 0").select(F.col("id").alias("q_key"), F.col("vector").alias("q_vector"), spec.alias("spec")))
    expected = []
    for i, s in enumerate(SPECS):
        own = asked.where(F.col("q_key") % len(SPECS) == i)
        where = filters.compile_filter(json.loads(s)) if s else F.lit(True)
        expected += told(search.search(own, p, 6, "q_key", ["id"], where, exclude="id", fallback=fallback), ["fallback_used"] if fallback else [])
    more = ["fallback_used"] if fallback else []
    assert told(search.search(asked, p, 6, "q_key", ["id"], exclude="id", fallback=fallback, spec="spec"), more) == sorted(expected)
    assert told(cells.search(asked, cells.build(p, ["id"]), 6, "q_key", exclude="id", fallback=fallback, spec="spec"), more) == sorted(expected)
    assert not fallback or any(x[-1] for x in expected) and not all(x[-1] for x in expected)


def test_wrong_filters_of_queries(spark):
    p = stage(points(spark, 60))
    for bad in ({"key": "label", "match": {"value": 1}}, {"key": "month"}, {"key": "month", "match": {"value": "7"}}, {"key": "month", "range": {"near": 1}}):
        asked = p.limit(3).select(F.col("id").alias("q_key"), F.col("vector").alias("q_vector"), F.lit(json.dumps({"must": [bad]})).alias("spec"))
        with pytest.raises(Exception, match="(?i)filter key|needs match|no value|bounds"):
            search.search(asked, p, 2, "q_key", ["id"], spec="spec").collect()


def test_cells_are_skipped(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(64, 16))
    x = centres[rng.integers(0, 64, 4000)] + rng.normal(size=(4000, 16)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = stage(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>").repartition(4))
    asked = p.where("id % 20 = 0").select(F.col("id").alias("q_key"), F.col("vector").alias("q_vector"))
    hits, met = cells.found(asked, cells.build(p, ["id"]), 5, "q_key", exclude="id", count=True)
    assert met < 0.2
    assert told(hits) == told(search.search(asked, p, 5, "q_key", ["id"], exclude="id"))


def test_cells_of_nothing(spark):
    p = points(spark, 40)
    asked = p.select(F.col("id").alias("q_key"), F.col("vector").alias("q_vector"), F.lit("x").alias("more"))
    for left in (p.limit(0), p.where("vector is null")):
        assert cells.search(asked, cells.build(left, ["id"]), 3, "q_key", fallback=True).count() == 0
    assert cells.search(asked.limit(0), cells.build(p, ["id"]), 3, "q_key").count() == 0
    zeros = p.withColumn("vector", F.transform("vector", lambda x: x * 0))
    assert {r.id for r in cells.search(asked, cells.build(zeros, ["id"]), 3, "q_key").collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        cells.search(asked, cells.build(p, ["id"]), 0, "q_key")
    with pytest.raises(Exception, match="must have 16 dimensions"):
        cells.search(asked.withColumn("q_vector", F.slice("q_vector", 1, 3)), cells.build(p, ["id"]), 3, "q_key").collect()


def test_a_large_cell_is_spread(spark):
    p = spark.range(4000).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector")).repartition(4)
    index = cells.build(p, ["id"])
    parts = index.blocks.groupBy(F.input_file_name()).agg(F.sum("n").alias("n")).collect()
    assert len(parts) >= 3 and sum(r["n"] for r in parts) == 4000 and max(r["n"] for r in parts) < 2500


def test_questions_as_columns(spark):
    asked = ["weekend peak in summer", "Workday mornings", "late night in July", "anything at all", "夏季周末", "高峰 load", "purchase, on weekends", "  ", "", "view", None, "purchases"]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, q string").select("i", "q", intent.filters_of("q", ("purchase", "view")).alias("f")).collect()
    for r in rows:
        expected = intent.parse_intent(r.q or "", ("purchase", "view"))
        assert (json.loads(r.f) if r.f else filters.empty()) == expected, r.q


def test_queries_go_to_their_cells_in_small_batches(spark, monkeypatch):
    """However many cells a query meets, a task gives a bounded number of rows at once."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    asked = points.where("id % 20 = 0").select(F.col("id").alias("q"), F.col("vector").alias("q_vector"))
    index = cells.build(points, ["id"], cells=40)
    sizes = []
    monkeypatch.setattr(cells, "GIVEN", 7)
    monkeypatch.setattr(cells, "ANGLES", 100)
    hits = sorted((r.q, r.rank_no, r.id) for r in cells.search(asked, index, 4, "q", exclude="id").collect())
    score = np.where(np.eye(300, dtype=bool), -np.inf, np.round(x @ x.T, 9))
    want = sorted((q, n + 1, int(i)) for q in range(0, 300, 20) for n, i in enumerate(np.lexsort((np.arange(300), -score[q]))[:4]))
    assert hits == want
    held = asked.withColumn("_kth", F.lit(float("-inf"))).coalesce(1)
    seen = {r["cell"]: (r["n"], r["lo"], r["hi"]) for r in index.blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}

    class Given:
        def mapInArrow(self, run, schema):  # noqa: N802
            rows = held.toArrow().to_batches()
            sizes.extend(b.num_rows for b in run(iter(rows)))

        schema, sparkSession, columns = held.schema, spark, held.columns  # noqa: N815

    cells._toward(Given(), index, False, 4, seen)
    assert sum(sizes) > 200 and max(sizes) <= 7


def test_what_is_sent_does_not_go_with_the_cells(spark, monkeypatch):
    """Queries of random vectors meet all cells, but go to the grid's groups of blocks alone; a task that holds few points adds groups."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = stage(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>").repartition(4))
    asked = p.where("id % 3 = 0").select(F.col("id").alias("q_key"), F.col("vector").alias("q_vector"))
    index, sent, toward = cells.build(p, ["id"], cells=60), [], cells._toward

    def counted(*a):
        out = stage(toward(*a))
        sent.append(out.count())
        return out

    monkeypatch.setattr(cells, "_toward", counted)
    want = told(search.search(asked, p, 5, "q_key", ["id"], exclude="id"))
    assert told(cells.search(asked, index, 5, "q_key", exclude="id")) == want
    assert sum(sent) <= 3 * asked.count()  # 60 rows a query before
    monkeypatch.setattr(cells, "HELD", 100)
    assert told(cells.search(asked, index, 5, "q_key", exclude="id")) == want
