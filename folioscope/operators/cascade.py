"""Searches answered by the first of several exact look-ups, before any full-text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_stage(asked: DataFrame, stages: list[tuple[str, str, DataFrame]], otherwise: str, parts: int | None = None) -> DataFrame:
    """asked with stage and target: the first stage whose table has the row's key, or otherwise with no target.

    A stage is (name, key column of asked, table of key and target). Of several targets of a key the least counts.
    A null key finds nothing; rows with null keys are dealt by all they ask for, as one task would get them all otherwise. Each table
    is reduced to one row a key before it is joined, so rows never multiply. parts: into how many parts rows are dealt, the planner's own number if None.
    """
    found = asked.drop("stage", "target")
    columns = found.columns
    whole = F.xxhash64(*(c for c, kind in found.dtypes if "map<" not in kind))
    found = found.withColumns({"_whole": whole, "_stage": F.lit(None).cast("string"), "_target": F.lit(None).cast("string")})
    dealt = None
    for name, key, table in stages:
        if key != dealt:
            found, dealt = found.withColumn("_apart", F.when(F.col(key).isNull(), F.col("_whole")).otherwise(F.lit(0).cast("long"))), key
            found = found.repartition(parts, key, "_apart") if parts else found
        # Always 0, but made of the key: the optimizer would take a plain 0 out of the join, and rows would be dealt by key alone.
        reduced = table.where("key IS NOT NULL").select(F.col("key").alias("_key"), (F.xxhash64("key") % 1).alias("_none"), "target")
        reduced = reduced.groupBy("_key", "_none").agg(F.min("target").cast("string").alias("_found"))
        found = found.join(reduced, (F.col(key) == F.col("_key")) & (F.col("_apart") == F.col("_none")), "left")
        hit = F.when(F.col("_found").isNotNull(), name)
        found = found.withColumns({"_stage": F.coalesce("_stage", hit), "_target": F.coalesce("_target", "_found")}).drop("_key", "_none", "_found")
    return found.select(*columns, F.coalesce("_stage", F.lit(otherwise)).alias("stage"), F.col("_target").alias("target"))
