"""A merge of one state into another as a signed plan: made once, verified, applied by compare-and-set, undone by its inverse.

Rows are compared in a canonical form, the JSON of their fields. A digest of a state or of a plan is sums over
row hashes, so it needs no order and no list of rows. A plan's actions are a table; only digests and counts reach
the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.stored import remove, written

INSERT, UPDATE, DELETE = "insert", "update", "delete"
HALF = 30


class MergeRefused(Exception):
    """The plan, the source or the target is not what it was when the plan was made."""


@dataclass(frozen=True)
class Plan:
    """actions: (key, action, expected, desired), keys and rows as JSON; expected is null for inserts, desired for deletes."""

    keys: tuple[str, ...]
    fields: tuple[str, ...]
    actions: DataFrame
    source_digest: str
    before: str
    projected: str
    signature: str


def _json(columns: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def canonical(state: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """(key, value) of each row."""
    return state.select(_json(keys).alias("key"), _json(fields).alias("value"))


def digest(rows: DataFrame) -> str:
    """Of a table's rows, whatever their order: their number and sums of four parts of their SHA-256."""
    hashed = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256).alias("h"))
    parts = hashed.select(*(F.conv(F.substring("h", 1 + 16 * i, 15), 16, 10).cast("long").alias(f"p{i}") for i in range(4)))
    # 60 bits as two sums of 30 each, which are plain numbers to Spark, where decimals are objects; they hold for 2**33 rows.
    halves = [F.sum(half) for i in range(4) for half in (F.shiftright(f"p{i}", HALF), F.col(f"p{i}").bitwiseAND((1 << HALF) - 1))]
    n, *sums = (x or 0 for x in parts.agg(F.count("*"), *halves).first())
    return "-".join(map(str, [n, *((high << HALF) + low for high, low in zip(sums[::2], sums[1::2], strict=True))]))


def _signed(actions: DataFrame, *parts: object) -> str:
    import hashlib

    return hashlib.sha256("|".join([digest(actions), *map(str, parts)]).encode()).hexdigest()


def _projected(target: DataFrame, actions: DataFrame) -> DataFrame:
    """(key, value) after the actions."""
    both = target.join(actions.select("key", "action", "desired"), "key", "full_outer")
    value = F.when(F.col("action").isNull(), F.col("value")).otherwise(F.col("desired"))
    return both.select("key", value.alias("value")).where("value IS NOT NULL")


def make_plan(source: DataFrame, target: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...], only: Column | None = None, insert: bool = True) -> Plan:
    """What makes target agree with source where source has a row (of those that only chooses); the target's other rows stay.

    Keys are unique in each state. Without insert, keys that the target lacks are refused.
    """
    chosen = source if only is None else source.where(only)
    have, want = written(canonical(target, keys, fields), "target"), canonical(chosen, keys, fields)
    whole = written(canonical(source, keys, fields), "source")
    want = whole if only is None else want
    both = want.withColumnRenamed("value", "desired").join(have.withColumnRenamed("value", "expected"), "key", "left")
    differs = both.where("expected IS NULL OR expected <> desired").withColumn("action", F.when(F.col("expected").isNull(), INSERT).otherwise(UPDATE))
    actions = written(differs.select("key", "action", "expected", "desired"), "plan")
    if not insert and (missing := actions.where(F.col("action") == INSERT).count()):
        raise MergeRefused(f"the target lacks {missing} keys of the source")
    digests = digest(whole), digest(have), digest(_projected(have, actions))
    remove(whole)
    remove(have)
    return Plan(keys, fields, actions, *digests, _signed(actions, keys, fields, *digests))


def verify(plan: Plan, source: DataFrame | None = None) -> None:
    """Refuses a plan that was changed, or whose source was."""
    if _signed(plan.actions, plan.keys, plan.fields, plan.source_digest, plan.before, plan.projected) != plan.signature:
        raise MergeRefused("the plan's signature doesn't fit")
    if source is not None and digest(canonical(source, plan.keys, plan.fields)) != plan.source_digest:
        raise MergeRefused("the source changed after the plan was made")


def apply(plan: Plan, target: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """target after the plan: keys and fields, as a written table. Refuses if any row that it changes isn't as expected.

    Rows that the plan doesn't touch may have changed or come since; then the digest of the result is not compared
    with the projection. Nothing is published here: dropping the result is a test run.
    """
    verify(plan, source)
    have = written(canonical(target, plan.keys, plan.fields), "target")  # read four times below
    checked = plan.actions.join(have, "key", "left").where(~F.col("expected").eqNullSafe(F.col("value")))
    if changed := checked.count():
        raise MergeRefused(f"{changed} rows of the target changed, such as {checked.select('key').first()[0]}")
    after = written(_projected(have, plan.actions), "merged")
    if digest(have) == plan.before and digest(after) != plan.projected:
        raise MergeRefused("the result is not the projected one")
    remove(have)
    types = {f.name: f.dataType for f in target.schema}
    read = lambda column, names: F.from_json(column, ", ".join(f"`{n}` {types[n].simpleString()}" for n in names))
    return after.select(read("key", plan.keys).alias("k"), read("value", plan.fields).alias("v")).select("k.*", "v.*")


def inverse(plan: Plan) -> Plan:
    """The plan that takes plan's result back to what was before."""
    action = F.when(F.col("action") == INSERT, DELETE).when(F.col("action") == DELETE, INSERT).otherwise(UPDATE)
    turned = written(plan.actions.select("key", action.alias("action"), F.col("desired").alias("expected"), F.col("expected").alias("desired")), "plan")
    signature = _signed(turned, plan.keys, plan.fields, plan.source_digest, plan.projected, plan.before)
    return replace(plan, actions=turned, before=plan.projected, projected=plan.before, signature=signature)
