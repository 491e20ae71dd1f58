"""op13: documents resampled towards the benchmark's word distribution."""

from folioscope.llm.importance import draw, importance_weights
from folioscope.llm.storage import table


def op13_suffix_runs(spark, sf_dir):
    weights = importance_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return draw(weights).select("doc_id", "n_features", "weight", "score", "rank")


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of text's UTF-8 bytes: DuckDB has no function for it, so bytes are folded by a table."""
    step = "xor(list_extract(crc, cast((xor(acc, byte) & 255) + 1 AS INT)), acc >> 8)"
    return f"xor(list_reduce([4294967295]::BIGINT[] || list_transform(range(1, strlen(hex({text})) // 2 + 1), lambda i: cast('0x' || hex({text})[2 * i - 1 : 2 * i] AS BIGINT)), lambda acc, byte: {step}), 4294967295)"


#: The table of the reflected polynomial: eight shifts of each byte.
_TABLE = """
crc_table AS (
  WITH RECURSIVE shifted AS (
    SELECT b, b AS c, 0 AS n FROM range(256) AS bytes(b)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM shifted WHERE n < 8)
  SELECT list(c ORDER BY b) AS crc FROM shifted WHERE n = 8)"""
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op13_suffix_runs": op13_suffix_runs}
ORACLE_SQL = {
    "op13_suffix_runs": f"""
WITH {_TABLE},
w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT {_WORDS} AS words FROM benchmark),
runs AS (
  SELECT doc_id, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram FROM w),
wanted AS (SELECT unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram FROM b),
grams AS (SELECT DISTINCT gram FROM (SELECT gram FROM runs UNION ALL SELECT gram FROM wanted)),
hashed AS (SELECT gram, {_crc32('gram')} % 10000 AS bucket FROM grams, crc_table),
s AS (SELECT bucket, count(*) AS s FROM runs JOIN hashed USING (gram) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (gram) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM runs) AS all_s, (SELECT count(*) FROM wanted) AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)))) AS gain
  FROM s FULL JOIN t USING (bucket), sums),
weights AS (
  SELECT doc_id, count(*) AS n_features, cast(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM runs JOIN hashed USING (gram) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('7:' || w.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN weights ON weights.doc_id = w.doc_id),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn ON drawn.doc_id = scored.doc_id
"""
}
