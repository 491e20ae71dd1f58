"""State transitions as functions from old state and changes to new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """old, and for keys that old lacks the first new row by order."""
    first = F.min_by(F.struct(*new.columns), F.struct(*order))
    fresh = new.groupBy(*keys).agg(first.alias("r")).select("r.*").join(old, keys, "left_anti")
    return old.unionByName(fresh)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, the listed columns come from new and the others from old."""
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    joined = o.join(n, keys, "full_outer")
    chosen = [F.when(F.col("_n").isNotNull() & (F.col("_o").isNull() | F.lit(c in columns)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c not in keys]
    return joined.select(*keys, *chosen)


def replace_children(old: DataFrame, new: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """Children of the given parents are replaced by new ones, those of all others stay."""
    return old.join(parents, parent, "left_anti").unionByName(new.join(parents, parent, "left_semi"))


def newest_version(rows: DataFrame, key: str, version: Column) -> DataFrame:
    """One row for each key: the one with the greatest version; version must be unique within a key."""
    newest = F.max_by(F.struct(*[c for c in rows.columns if c != key]), version)
    return rows.groupBy(key).agg(newest.alias("r")).select(key, "r.*")


def difference(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): missing (only in new), extra (only in old) or changed, for keys whose rows differ."""
    o = old.select(key, F.struct(*columns).alias("o"), F.lit(True).alias("in_old"))
    n = new.select(key, F.struct(*columns).alias("n"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "missing").when(F.col("in_new").isNull(), "extra").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def cascade(parents_gone: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Children without those of the parents that are gone (one column of keys)."""
    (key,) = parents_gone.columns
    return {name: child.join(parents_gone.withColumnRenamed(key, column), column, "left_anti") for name, (child, column) in children.items()}
