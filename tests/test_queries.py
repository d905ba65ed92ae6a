"""Every query with SQL against DuckDB on the small provided tables."""

import math
import os

import duckdb
import pytest

from corpuloom import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in queries.TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER)
    want = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    rows = lambda it: sorted(repr(tuple(plain(v) for v in r)) for r in it)
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(tuple(r[i] for i in order) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    found = queries.QUERIES["find_filter_sort_limit"](spark, FOLDER)
    assert "TakeOrderedAndProject" in plan_of(found)
    assert "BroadcastHashJoin" in plan_of(queries.QUERIES["closest_ref"](spark, FOLDER))
    wc = plan_of(queries.QUERIES["catalog_by_kind"](spark, FOLDER))
    assert wc.count("HashAggregate") == 2 and "partial_sum" in wc
    assert "ReadSchema: struct<doc_id:bigint>" in plan_of(queries.QUERIES["prune_candidates"](spark, FOLDER))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_types(spark, duck, name):
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    want = duck.sql(queries.ORACLE_SQL[name])
    got = {k: kinds[v] for k, v in queries.QUERIES[name](spark, FOLDER).dtypes}
    assert got == dict(zip(want.columns, map(str, want.types), strict=True))
