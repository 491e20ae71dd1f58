"""Users' lists after a batch of requests to create, rename and delete them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators.lists import apply_decisions, decide
from folioscope.plans.personal import _LISTS, _lists
from folioscope.plans.registry import Registry
from folioscope.plans.relations import with_ctes

registry = Registry()
query = registry.query

_DECIDED = (
    _LISTS
    + """, requests AS (SELECT user_id, list_name || mark AS request_id, CASE (user_id + length(list_name)) % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'create' ELSE 'rename' END AS action, list_name || mark AS list_name,
  trim(CASE user_id % 6 WHEN 0 THEN 'starred ' WHEN 1 THEN ' ' WHEN 2 THEN 'VIEW' WHEN 3 THEN 'same' ELSE upper(list_name) || ' 2' END) AS wish FROM lists, (VALUES (''), ('!')) m(mark) WHERE mark = '' OR user_id % 5 = 0),
r AS (SELECT q.*, CASE WHEN action <> 'delete' THEN wish END AS new_name, l.list_name AS held, l.is_starred, u.list_name AS used FROM requests q
  LEFT JOIN lists l ON l.user_id = q.user_id AND l.list_name = q.list_name AND action <> 'create' LEFT JOIN lists u ON u.user_id = q.user_id AND u.list_name = lower(wish) AND action <> 'delete'),
judged AS (SELECT *, CASE WHEN new_name = '' THEN 'invalid' WHEN lower(new_name) = 'starred' THEN 'reserved' WHEN action <> 'create' AND held IS NULL THEN 'not_found' WHEN action <> 'create' AND is_starred THEN 'protected'
  WHEN used IS NOT NULL AND (action = 'create' OR used <> list_name) THEN 'exists' ELSE action || 'd' END AS o FROM r),
decided AS (SELECT user_id, request_id, action, list_name, new_name, CASE WHEN o NOT IN ('created', 'renamed', 'deleted') OR new_name IS NULL THEN o
  WHEN request_id > min(CASE WHEN o IN ('created', 'renamed') THEN request_id END) OVER (PARTITION BY user_id, lower(new_name)) THEN 'exists' ELSE o END AS outcome FROM judged)"""
)


def _decided(spark, sf_dir):
    """A request for each list, and for some users one for a list that they don't have."""
    lists, saved = _lists(spark, sf_dir)
    wish = F.when(F.col("user_id") % 6 == 0, "starred ").when(F.col("user_id") % 6 == 1, " ").when(F.col("user_id") % 6 == 2, "VIEW").when(F.col("user_id") % 6 == 3, "same").otherwise(F.concat(F.upper("list_name"), F.lit(" 2")))
    turn = (F.col("user_id") + F.length("list_name")) % 4
    marks = F.when(F.col("user_id") % 5 == 0, F.array(F.lit(""), F.lit("!"))).otherwise(F.array(F.lit("")))
    asked = lists.select("user_id", F.when(turn == 0, "delete").when(turn == 1, "create").otherwise("rename").alias("action"), "list_name", wish.alias("new_name"), F.explode(marks).alias("mark"))
    asked = asked.withColumn("list_name", F.concat("list_name", "mark")).withColumn("request_id", F.col("list_name")).drop("mark")
    return lists, saved, decide(lists, asked)


@query(with_ctes("activity", more=_DECIDED) + "SELECT user_id, request_id, action, coalesce(new_name, '') AS new_name, outcome FROM decided")
def list_edit_outcomes(spark, sf_dir):
    return _decided(spark, sf_dir)[2].select("user_id", "request_id", "action", F.coalesce("new_name", F.lit("")).alias("new_name"), "outcome")


@query(with_ctes("activity", more=_DECIDED + """, kept AS (SELECT l.user_id, l.list_name AS old, coalesce(d.new_name, l.list_name) AS list_name, is_starred FROM lists l LEFT JOIN decided d ON d.user_id = l.user_id AND d.list_name = l.list_name AND outcome IN ('renamed', 'deleted')
  WHERE outcome IS NULL OR outcome = 'renamed' UNION ALL SELECT user_id, NULL, new_name, false FROM decided WHERE outcome = 'created')""") + """
SELECT k.user_id, k.list_name, k.is_starred, count(s.target) AS n FROM kept k LEFT JOIN saved s ON s.user_id = k.user_id AND s.list_name = k.old GROUP BY ALL""")  # fmt: skip
def list_edit_state(spark, sf_dir):
    """All lists after the requests, with the number of what each holds."""
    lists, saved = apply_decisions(*_decided(spark, sf_dir))
    counts = saved.groupBy("user_id", "list_name").agg(F.count("*").alias("n"))
    return lists.join(counts, ["user_id", "list_name"], "left").select("user_id", "list_name", "is_starred", F.coalesce("n", F.lit(0)).alias("n"))
