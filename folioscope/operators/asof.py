"""The latest row before a moment, and where chains of such rows end, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.stored import written

#: About so many rows of a large key are sorted together.
BLOCK = 4096
#: A key with more rows than so many blocks is large.
LARGE = 16


def latest_before(probes: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """probes (key, at, ...) with found, the struct `value` of the row (key, at, value) that is the key's last with a smaller at.

    Each row is shuffled once, by its key, and sorted there. Only the rows of large keys, of which there are as few as
    the rows divided by LARGE blocks, are cut into blocks of their key's time, each a group of its own; what a block starts with
    comes from one row for each block, so a key that holds a third of all rows is many small sorts and one sort of its
    blocks. Null keys find nothing; of rows with equal key and at any one is found.
    """
    spark, more = probes.sparkSession, [c for c in probes.columns if c not in ("key", "at")]
    none = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in more]
    asking = probes.select("key", "at", *more, F.lit(True).alias("_asks"), F.lit(None).cast(rows.schema["value"].dataType).alias("_value"))
    both = asking.unionByName(rows.select("key", "at", *none, F.lit(False).alias("_asks"), F.col("value").alias("_value")))
    sizes = both.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).where(F.col("n") > LARGE * block)
    width = F.greatest(F.lit(1), F.floor((F.col("high") - F.col("low") + 1) * F.lit(float(block)) / F.col("n"))).cast("long")
    large = sizes.select(F.col("key").alias("_key"), "low", width.alias("width"))
    held = large.collect()  # a row for each large key

    def inside(rows: DataFrame, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy("at", ~F.col("_asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("_here", F.last("_value", ignorenulls=True).over(order)).where("_asks")

    def shown(met: DataFrame, found: Column) -> DataFrame:
        return met.select(*probes.columns, F.when(F.col("key").isNotNull(), found).alias("found"))

    if not held:
        return shown(inside(both, "key"), F.col("_here"))
    large = F.broadcast(spark.createDataFrame(held, large.schema))
    same = F.col("key").eqNullSafe(F.col("_key"))
    small = shown(inside(both.join(large, same, "left_anti"), "key"), F.col("_here"))
    cut = both.join(large, same).withColumn("_block", F.expr("(at - low) div width")).drop("_key", "low", "width")
    lasts = cut.groupBy("key", "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("at"))).alias("_last"))
    earlier = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(F.col("key").alias("_key"), F.col("_block").alias("_at"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    met = inside(cut, "key", "_block").join(carried, same & (F.col("_block") == F.col("_at")), "left")
    return small.unionByName(shown(met, F.coalesce("_here", "_carried")))


def followed(nodes: DataFrame) -> DataFrame:
    """nodes (id, up, odd, value, ...) without up: the value where its chain of ups ends, and whether an odd number of odd nodes is passed.

    A node without up ends its chain. Every round doubles how far a node has come, so a chain of a thousand takes ten
    rounds; each round is one join with unique ids and writes only the nodes that it moved, so lost executors cost tasks
    only. Other columns stay. The result reads the tables of all rounds.
    """
    more = [c for c in nodes.columns if c not in ("id", "up", "odd", "value")]
    last = written(nodes.select("id", "up", "odd", "value", *more), "chains")
    ended = last.where("up IS NULL")
    while not (open_ := last.where("up IS NOT NULL")).isEmpty():
        n = ended.unionByName(open_).select(F.col("id").alias("up"), F.struct("up", "odd", "value").alias("n"))
        moved = open_.join(n, "up").select("id", F.col("n.up").alias("up"), (F.col("odd") != F.col("n.odd")).alias("odd"), F.col("n.value").alias("value"), *more)
        last = written(moved, "chains")
        ended = ended.unionByName(last.where("up IS NULL"))
    return ended.drop("up")
