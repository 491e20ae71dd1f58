"""op12: benchmark passages in every document."""

from pyspark.sql import functions as F

from folioscope.llm.decontamination import find_benchmark_passages
from folioscope.llm.storage import table


def op12_shard_fm_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark_passages(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    digest = F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op12_shard_fm_index": op12_shard_fm_index}
ORACLE_SQL = {
    "op12_shard_fm_index": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, k, array_to_string(words[i : i + k - 1], ' ') AS gram
  FROM (SELECT item_id, words, least(len(words), 10) AS k, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM b WHERE len(words) > 0)),
grams AS (
  SELECT doc_id, i, k, array_to_string(words[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, words, k, unnest(range(1, cast(len(words) - k + 2 AS BIGINT))) AS i FROM w, (SELECT DISTINCT k FROM phrases) WHERE len(words) >= k)),
found AS (SELECT doc_id, i, k, item_id FROM grams JOIN phrases USING (k, gram)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT w.doc_id, cast(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id LEFT JOIN items ON items.doc_id = w.doc_id
"""
}
