"""Registered queries against their SQL on the small tables."""

import math
import os

import duckdb
import pytest

from corridor.plans import numeric_queries, queries, source_queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")
SQL = queries.ORACLE_SQL | numeric_queries.ORACLE_SQL | source_queries.ORACLE_SQL
QUERIES = queries.QUERIES | numeric_queries.QUERIES | source_queries.QUERIES


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return "[" + ",".join(map(norm, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    ours = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert ours == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_no_trim_or_sample_is_vacuous(spark):
    for name in ("final_trim", "sampled_rows"):
        n, total = QUERIES[name](spark, DIR).count(), spark.read.parquet(f"{DIR}/events.parquet").count()
        assert 0 < n < total


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_nested_loops_in_nearest_and_asof_joins(spark):
    for name in ("asof_nearest", "asof_backward", "nearest_point"):
        plan = queries.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


ROWS_ONLY = sorted(set(QUERIES) - set(SQL) - {"fuse_corridor"})


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, name):
    rows = QUERIES[name](spark, DIR).collect()
    assert rows
    if name == "frenet_roundtrip":
        # half a step along and, on the line itself, the same taken for an offset
        assert max(r.error for r in rows if r.error is not None) < 0.5 / 2**0.5 + 1e-3
    if name == "fuse_suppliers":
        assert len(rows) == spark.read.parquet(f"{DIR}/supplier.parquet").count()
        assert {r.most_tracks for r in rows} == {2} and {r.speed for r in rows} == {18.0, 19.0, 20.0} and max(r.off for r in rows) < 1
    if name == "stream_tracked":
        assert len(rows) == spark.read.parquet(f"{DIR}/events.parquet").count()


def events_like(folder, values: str):
    """The driver's events with other values, and a connection that sees them."""
    c = duckdb.connect()
    c.sql(f"COPY (SELECT * REPLACE ({values} AS value) FROM '{DIR}/events.parquet') TO '{folder}/events.parquet'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return c


def equal_on(spark, c, name, folder):
    df, rel = QUERIES[name](spark, str(folder)), c.execute(SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(tuple(norm(r[n]) for n in names) for r in df.collect()) == sorted(tuple(map(norm, r)) for r in rel.fetchall())


@pytest.mark.parametrize("values", ["value + 600 * (event_id % 2)", "CASE WHEN event_id % 3 = 0 THEN 199.8 ELSE value END"])
def test_cleaning_chain_beyond_the_planted_lane_and_on_its_line(spark, tmp_path, values):
    equal_on(spark, events_like(tmp_path, values), "cleaning_chain", tmp_path)


def test_label_lanes_beyond_the_planted_lanes(spark, tmp_path):
    equal_on(spark, events_like(tmp_path, "value + 600 * (event_id % 2)"), "label_lanes", tmp_path)
