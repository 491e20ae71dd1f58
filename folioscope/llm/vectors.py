"""Columns shared by the vector searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True where the vector is there and all of its components are there and finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def least_copies(vectors: DataFrame, copies: int) -> DataFrame:
    """Of equal vectors (column vector) keeps those with the smallest ids (column id).

    With k results for each query and ties going to smaller ids, no copy beyond the k + 1 smallest can
    be in any result, so nothing is lost. The limit is applied before the shuffle as well, so a vector
    that a third of all rows share sends only a few rows from each task.
    """
    order = Window.partitionBy("vector").orderBy("id")
    return vectors.withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") <= copies).drop("_copy")


def best_per_query(found: DataFrame, order: list[Column], k: int) -> DataFrame:
    """(query_id, rank int from 1, id, score): the first k of each query; found holds each pair once."""
    by_query = Window.partitionBy("query_id").orderBy(*order)
    ranked = found.withColumn("rank", F.row_number().over(by_query).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
