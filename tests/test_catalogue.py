"""Every query runs on the smallest tables and, where it has SQL, gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from folioscope.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF_DIR}/{name}')")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    if name in SQL:
        answer = duck.execute(SQL[name])
        names = [d[0] for d in answer.description]
        assert sorted(names) == columns
        places = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[p]) for p in places) for r in answer.fetchall()), key=repr)


def test_pages_are_taken_without_a_full_sort(spark):
    plan = QUERIES["offset_page_three"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = QUERIES["list_filter_year_range"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_custkey" not in plan
