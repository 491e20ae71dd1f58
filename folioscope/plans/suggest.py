"""Labels suggested for phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators.suggestions import suggest_labels
from folioscope.plans.registry import Registry
from folioscope.plans.relations import table

registry = Registry()
query = registry.query

_RULES = """WITH labels AS (SELECT min(p_partkey) AS position, lower(p_type) || '-' || replace(p_name, ' ', '_') AS key, p_name || ' ' || p_type AS title FROM part GROUP BY ALL),
phrases AS (SELECT p_name AS phrase FROM part UNION SELECT p_name || ' ' || lower(p_type) FROM part UNION SELECT lower(p_type) || ' ' || p_name FROM part UNION SELECT replace(p_name, ' ', '-') FROM part
  UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT 'the ' || p_name || ' ' || p_type || 's' FROM part UNION SELECT split_part(p_name, ' ', 2) || ' of ' || lower(p_type) FROM part
  UNION SELECT split_part(p_name, ' ', 2) || ' ' || left(lower(p_type), 4) FROM part UNION SELECT p_brand FROM part),
p AS (SELECT phrase, lower(phrase) AS l, translate(lower(phrase), ' -_', '') AS n, string_split(lower(phrase), ' ') AS words FROM phrases WHERE phrase <> ''),
k AS (SELECT position, key, lower(title) AS t, translate(lower(key), '-_', '') AS n FROM labels),
hits AS (SELECT phrase, key, position, CASE WHEN l = t THEN 0 WHEN k.n = p.n THEN 1 WHEN length(p.n) >= 4 AND (starts_with(k.n, p.n) OR starts_with(p.n, k.n)) THEN 2 WHEN contains(t, l) THEN 3 WHEN contains(l, t) THEN 4
  WHEN length(p.n) >= 4 AND (contains(k.n, p.n) OR contains(p.n, k.n)) THEN 5 WHEN len(words) > 1 AND len(list_filter(words, lambda w: NOT contains(k.n, w))) = 0 THEN 6 WHEN len(words) > 1 AND len(list_filter(words, lambda w: NOT contains(t, w))) = 0 THEN 7 END AS rule FROM p, k)
"""


@query(_RULES + """SELECT phrase, rank, key, ['exact title', 'key match', 'key prefix', 'in title', 'title in phrase', 'key substr', 'words in key', 'words in title'][rule + 1] AS kind
FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY rule > 2, CASE WHEN rule > 2 THEN position ELSE -position END) AS rank FROM hits WHERE rule IS NOT NULL) WHERE rank <= 8""")  # fmt: skip
def label_suggestions(spark, sf_dir):
    """Up to eight labels for each phrase; labels are parts' names and types, phrases are names in several spellings."""
    part = table(spark, sf_dir, "part")
    kind, name = F.lower("p_type"), F.col("p_name")
    labels = part.groupBy("p_type", "p_name").agg(F.min("p_partkey").alias("position"))
    labels = labels.select("position", F.concat(kind, F.lit("-"), F.replace(name, F.lit(" "), F.lit("_"))).alias("key"), F.concat_ws(" ", name, "p_type").alias("title"))
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    spelled = [name, F.concat_ws(" ", name, kind), F.concat_ws(" ", kind, name), F.replace(name, F.lit(" "), F.lit("-")), first, F.concat(F.lit("the "), name, F.lit(" "), "p_type", F.lit("s")), F.concat(second, F.lit(" of "), kind), F.concat(second, F.lit(" "), F.left(kind, F.lit(4))), F.col("p_brand")]
    return suggest_labels(part.select(F.explode(F.array(*spelled)).alias("phrase")), labels)
