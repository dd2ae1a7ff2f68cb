"""Every query against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from echofold.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return c


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a = sorted(tuple(map(cell, r)) for r in got.collect())
    b = sorted(tuple(map(cell, r)) for r in want.select(", ".join(got.columns)).fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def long_turns(tmp_path_factory):
    """Hourly events of three weeks, and conversations whose first turns name workdays after 600 characters."""
    d = tmp_path_factory.mktemp("turns")
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(i::INT) AS ts, 'view' AS event_type, round(random() * 100, 2) AS value FROM range(500) t(i)) TO '{d}/events.parquet'")
    duckdb.sql(f"COPY (SELECT i AS conv_id, 0 AS turn, repeat('lorem ', 100) || 'workday' AS text FROM range(6) t(i)) TO '{d}/conversations.parquet'")
    return d


@pytest.mark.parametrize("name", ["hits_by_question", "forecast_by_question"])
def test_whole_turns_are_read_for_filters(spark, long_turns, name):
    c = duckdb.connect()
    for t in ("events", "conversations"):
        c.sql(f"CREATE VIEW {t} AS FROM '{long_turns}/{t}.parquet'")
    rows = catalogue.queries()[name](spark, str(long_turns))
    got, want = rows.collect(), c.sql(catalogue.oracle_sql()[name]).select(", ".join(rows.columns)).fetchall()
    assert sorted(tuple(map(cell, r)) for r in got) == sorted(tuple(map(cell, r)) for r in want)
    if name == "hits_by_question":  # weekends that are workdays don't exist, so all of these fall back; other days do
        of = lambda n: {r.fallback_used for r in got if int(r.q_key.split("|")[1]) // 20 % 6 == n}
        assert of(0) == {True} and of(1) == {False}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
