import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.operators.snapshots import CommitConflict
from folioscope.sources.cache import RecordCache, batches, by_position

ANSWERS = "batch string, keys array<string>, records array<string>, fetched_at timestamp"
ROW = "key string, record string, fetched_at timestamp"


def day(n):
    return datetime(2024, 1, n)


def rows(cache):
    return {r.key: (r.record, r.fetched_at) for r in cache.read().collect()}


def test_missing_put_late_and_not_found(spark, scratch):
    cache = RecordCache(spark, f"file://{scratch}/cache", buckets=8)
    wanted = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("c",)], "key string")
    assert sorted(r.key for r in cache.missing(wanted).collect()) == ["a", "b", "c"] and cache.read().isEmpty()
    asked = batches(cache.missing(wanted), 2)
    assert sorted(k for r in asked.collect() for k in r["keys"]) == ["a", "b", "c"] and all(len(r["keys"]) <= 2 for r in asked.collect())
    assert cache.put(by_position(spark.createDataFrame([("0", ["a", "b"], ['{"t":1}', None], day(5))], ANSWERS))) == 1
    assert rows(cache) == {"a": ('{"t":1}', day(5)), "b": (None, day(5))}
    assert [r.key for r in cache.missing(wanted).collect()] == ["c"]
    assert sorted(r.key for r in cache.missing(wanted, day(20), retry_days=10).collect()) == ["b", "c"]
    assert [r.key for r in cache.missing(wanted, day(10), retry_days=10).collect()] == ["c"]
    late = [("a", "older", day(4)), ("b", "found", day(6)), ("b", None, day(6)), ("c", None, None), ("c", "x", None), (None, "x", day(9))]
    assert cache.put(spark.createDataFrame(late, ROW)) == 2
    assert rows(cache) == {"a": ('{"t":1}', day(5)), "b": ("found", day(6)), "c": ("x", None)}
    assert cache.put(spark.createDataFrame([], ROW)) == 2


def test_wrong_lengths_store_nothing(spark, scratch):
    cache = RecordCache(spark, f"file://{scratch}/cache")
    for records in (["x"], None, ["x", "y", "z"]):
        with pytest.raises(Exception, match="do not match its keys"):
            cache.put(by_position(spark.createDataFrame([("7", ["a", "b"], records, day(1)), ("8", ["c"], ["y"], day(1))], ANSWERS)))
    assert cache.version() == 0 and cache.read().isEmpty()
    with pytest.raises(ValueError):
        batches(spark.createDataFrame([], "key string"), 501)


def test_only_touched_buckets_are_written(spark, scratch):
    cache = RecordCache(spark, f"file://{scratch}/cache", buckets=16)
    many = spark.range(400).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("old").alias("record"), F.lit(day(1)).alias("fetched_at"))
    cache.put(many)
    before = cache._folders(1)
    assert len(before) == 16
    cache.put(spark.createDataFrame([("k7", "new", day(2))], ROW))
    after = cache._folders(2)
    assert sum(before[b] != after[b] for b in before) == 1
    found = rows(cache)
    assert len(found) == 400 and found["k7"] == ("new", day(2)) and {found[k][0] for k in found if k != "k7"} == {"old"}
    folder = next(f for b, f in after.items() if f != before[b])
    assert [n for n in os.listdir(f"{scratch}/cache/rows/{folder}") if n.startswith("bucket=")] == [f"bucket={b}" for b in after if after[b] == folder]


def test_two_writers(spark, scratch):
    cache = RecordCache(spark, f"file://{scratch}/cache", buckets=4)
    cache.put(spark.createDataFrame([("a", "1", day(1))], ROW))
    with pytest.raises(CommitConflict):
        cache._publish(1, {0: "other"})
    assert rows(cache) == {"a": ("1", day(1))}
