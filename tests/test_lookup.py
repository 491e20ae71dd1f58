from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.operators.cascade import first_stage
from folioscope.operators.lists import apply_decisions, decide
from folioscope.plans import list_edits, lookup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module, name", [(m, name) for m in (lookup, list_edits) for name in m.registry.queries])
def test_rows_equal_duckdb(spark, module, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "part", "supplier", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(module.registry.sql[name])
    columns = [c[0] for c in expected.description]
    wanted = expected.fetchall()
    got = module.registry.queries[name](spark, SF)
    assert wanted and sorted(got.columns) == sorted(columns)
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(wanted, key=key)


def test_a_citation_key_finds_its_paper(spark):
    first = lookup.citation_keys(spark, SF).orderBy("key").first()
    asked = spark.createDataFrame([(f"@article{{{first.key.upper()}, title",), (first.key,), (None,), ("no such thing",)], "q string")
    assert [(r.stage, r.target) for r in lookup.route(spark, SF, asked).collect() if r.q and r.q != "no such thing"] == [("citation", str(first.target))] * 2
    assert {(r.q, r.stage) for r in lookup.route(spark, SF, asked).collect()} >= {(None, "none"), ("no such thing", "text")}


def test_the_first_stage_wins_and_rows_stay_single(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "q string")
    one = spark.createDataFrame([("a", 2), ("a", 1), (None, 9)], "key string, target int")
    two = spark.createDataFrame([("a", 5), ("b", 6)], "key string, target int")
    got = first_stage(asked, [("one", "q", one), ("two", "q", two)], "none")
    assert sorted((r.q or "", r.stage, r.target) for r in got.collect()) == [("", "none", None), ("a", "one", "1"), ("a", "one", "1"), ("b", "two", "6"), ("c", "none", None)]


def test_list_requests(spark):
    lists = spark.createDataFrame([(1, "a", False), (1, "b", False), (1, "Starred", True)], "user_id int, list_name string, is_starred boolean")
    saved = spark.createDataFrame([(1, "a", 7), (1, "b", 8), (1, "Starred", 9)], "user_id int, list_name string, target int")
    asked = [
        (1, "rename", "A", " new "), (2, "create", None, "NEW"), (3, "rename", "a", "other"), (4, "delete", "b", None), (5, "delete", "starred", None),
        (6, "create", None, "STARRED"), (7, "create", None, None), (8, "rename", "none", "x"), (9, "create", None, "b"), (10, "create", None, "c"),
    ]
    requests = spark.createDataFrame([(1, *row) for row in asked], "user_id int, request_id int, action string, list_name string, new_name string")
    decided = decide(lists, requests)
    outcomes = {r.request_id: r.outcome for r in decided.collect()}
    assert outcomes == {1: "renamed", 2: "exists", 3: "not_found", 4: "deleted", 5: "protected", 6: "reserved", 7: "invalid", 8: "not_found", 9: "exists", 10: "created"}
    after, held = apply_decisions(lists, saved, decided)
    assert sorted(r.list_name for r in after.collect()) == ["Starred", "c", "new"]
    assert sorted((r.list_name, r.target) for r in held.collect()) == [("Starred", 9), ("new", 7)]


def test_rows_with_null_keys_are_dealt_apart(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    try:
        asked = spark.range(4000).select(F.concat(F.lit("s"), "id").alias("q"), F.when(F.col("id") < 4, F.col("id")).alias("key"))
        table = spark.createDataFrame([(2, 7), (2, 5), (3, 9)], "key long, target long")
        got = first_stage(asked, [("one", "key", table)], "none").withColumn("part", F.spark_partition_id()).collect()
        assert sorted((r.q, r.target) for r in got if r.stage == "one") == [("s2", "5"), ("s3", "9")] and len(got) == 4000
        assert max(Counter(r.part for r in got).values()) < 2000  # of four parts
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
