"""op11: every document as a fill-in-the-middle example."""

from pyspark.sql import functions as F

from folioscope.llm.fill_middle import fill_middle, restored
from folioscope.llm.storage import table


def op11_fill_middle(spark, sf_dir):
    made = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", back.alias("restored_sha256"))


QUERIES = {"op11_fill_middle": op11_fill_middle}
ORACLE_SQL = {
    "op11_fill_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(cast(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT doc_id, text, length(text) AS n, cast('0x' || h[1:8] AS BIGINT) AS h1, cast('0x' || h[9:16] AS BIGINT) AS h2,
    cast('0x' || h[17:24] AS BIGINT) AS h3, cast('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM f)
SELECT doc_id, cast(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN cast(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN cast(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
}
