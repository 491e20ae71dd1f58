"""Ordered children of parent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_list(children: DataFrame, key: str, order: Column, value: Column, name: str) -> DataFrame:
    """(key, name array): the values of each key in order; order must be unique within a key."""
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return children.groupBy(key).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def attach(parents: DataFrame, lists: DataFrame, parent_key: str, key: str, name: str) -> DataFrame:
    """Left join of lists; parents without children get an empty list."""
    empty = F.array().cast(lists.schema[name].dataType)
    joined = parents.join(lists.withColumnRenamed(key, "_key"), F.col(parent_key) == F.col("_key"), "left").drop("_key")
    return joined.withColumn(name, F.coalesce(name, empty))
