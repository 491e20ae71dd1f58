"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.storage import drop, store


SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) joined with least (a, m); a hub's edges are spread by their other ends."""
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    spread = salted.select("a", "_salt").distinct().join(least, "a")
    return salted.join(spread, ["a", "_salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return _with_least(both.where("b > a"), least)


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = store(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    return _with_least(down, least).union(least.select("a", "m"))


def _state(edges: DataFrame) -> tuple:
    """Row count and two exact sums of 64-bit hashes: equal for equal sets of links, whatever their order."""
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), "a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total(1), total(2)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) links to (id, component): the smallest id that each linked id can reach.

    Ids without a link are not in the result; self-links, repeated links and nulls are ignored.
    The rounds, about the logarithm of the longest path, shuffle links only; every round is a
    written table, and only a count and a checksum reach the driver. The result is a stored table.
    """
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct()
    now = store(links, "links")
    seen = None
    while (state := _state(now)) != seen:
        seen, before = state, now
        now = store(_small_star(_large_star(before)).where("a <> b").distinct(), "links")
        drop(before)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
