import duckdb
import pytest

from folioscope.plans import relations, review

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(review.registry.queries))
def test_rows_equal_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "part", "supplier", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(review.registry.sql[name])
    columns = [c[0] for c in expected.description]
    got = review.registry.queries[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(expected.fetchall(), key=key)


def test_unknown_order():
    with pytest.raises(ValueError):
        review.in_order("fastest")


@pytest.mark.parametrize("relation", [relations.candidates, relations.paper_authors])
def test_lines_are_dealt_once_and_grouped_after(spark, relation):
    plan = relation(spark, SF).groupBy("paper_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Aggregate" not in plan[plan.index("Exchange hashpartitioning") :]
