"""op1: words that repeat a 50-word window of an earlier document."""

from pyspark.sql import functions as F

from folioscope.llm.storage import table
from folioscope.llm.substring_dedup import remove_repeats


def op1_fm_index(spark, sf_dir):
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op1_fm_index": op1_fm_index}
ORACLE_SQL = {
    "op1_fm_index": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
firsts AS (SELECT win, min(doc_id) AS first FROM starts GROUP BY win HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM starts JOIN firsts USING (win) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM each ANTI JOIN hit USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, cast(len(words) AS BIGINT) AS n_words, cast(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
}
