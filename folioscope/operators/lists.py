"""Users' lists: created, renamed and deleted by a batch of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the name that no request may take.
RESERVED = "Starred"
NAME_LENGTH = 100


def decide(lists: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (user_id, request_id, action, list_name, new_name) with new_name cleaned and outcome.

    lists: (user_id, list_name, is_starred). Every request is judged by the lists before the batch; names are equal in
    any case. Outcomes, the first that holds: invalid (no name), reserved, not_found, protected (the starred list),
    exists; else created, renamed or deleted. Of several requests for one list the least request_id is done and the
    others find none; of several that would take one name likewise, and for the others it exists.
    """
    named, own = F.col("action") != "delete", F.col("action") != "create"
    name = F.when(named, F.substring(F.trim("new_name"), 1, NAME_LENGTH))
    r = requests.withColumn("new_name", name).withColumn("_name", F.lower("new_name")).withColumn("_list", F.when(own, F.lower("list_name")))
    # Stored names that differ in their case only are one list, starred if any of them is.
    held = lists.groupBy(F.col("user_id").alias("_u"), F.lower("list_name").alias("_held")).agg(F.bool_or("is_starred").alias("is_starred"))
    used = lists.select(F.col("user_id").alias("_v"), F.lower("list_name").alias("_used")).distinct()
    r = r.join(held, (F.col("user_id") == F.col("_u")) & (F.col("_list") == F.col("_held")), "left")
    r = r.join(used, (F.col("user_id") == F.col("_v")) & (F.col("_name") == F.col("_used")), "left")
    empty, taken = F.coalesce("_name", F.lit("")) == "", F.col("_used").isNotNull() & ~F.col("_name").eqNullSafe(F.col("_list"))
    outcome = (
        F.when(named & empty, "invalid").when(named & (F.col("_name") == RESERVED.lower()), "reserved").when(own & F.col("_held").isNull(), "not_found")
        .when(own & F.col("is_starred"), "protected").when(named & taken, "exists")
        .otherwise(F.element_at(F.create_map(*map(F.lit, ("create", "created", "rename", "renamed", "delete", "deleted"))), F.col("action")))
    )
    done = F.col("outcome").isin("created", "renamed", "deleted")
    for key, late in (("_list", "not_found"), ("_name", "exists")):
        r = r.withColumn("outcome", outcome if key == "_list" else F.col("outcome"))
        first = F.min(F.when(done, F.col("request_id"))).over(Window.partitionBy("user_id", key))
        r = r.withColumn("_first", first).withColumn("outcome", F.when(done & F.col(key).isNotNull() & (F.col("request_id") > F.col("_first")), late).otherwise(F.col("outcome")))
    return r.select(*requests.columns, "outcome")


def apply_decisions(lists: DataFrame, saved: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, saved) after the requests that were done; what is saved (user_id, list_name, ...) follows its list."""
    moved = decided.where("outcome IN ('renamed', 'deleted')").select("user_id", F.lower("list_name").alias("_key"), F.col("new_name").alias("_new"), F.lit(True).alias("_moved"))

    def follow(rows: DataFrame) -> DataFrame:
        joined = rows.withColumn("_key", F.lower("list_name")).join(moved, ["user_id", "_key"], "left").where("_moved IS NULL OR _new IS NOT NULL")
        return joined.withColumn("list_name", F.coalesce("_new", "list_name")).select(*rows.columns)

    created = decided.where("outcome = 'created'").select("user_id", F.col("new_name").alias("list_name"), F.lit(False).alias("is_starred"))
    return follow(lists).unionByName(created), follow(saved)
