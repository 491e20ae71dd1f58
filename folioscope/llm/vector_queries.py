"""op5 and op9: searches over embeddings."""

from pyspark.sql import functions as F

from folioscope.llm.hilbert_ann import nearest_neighbours
from folioscope.llm.nra_topk import top_inner_products
from folioscope.llm.storage import table


def op5_hilbert_ann(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = nearest_neighbours(rows, F.col("vec_id") % 100 == 0, "vec_id", "embedding", k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_nra_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = top_inner_products(rows, F.col("vec_id") % 50 == 0, "vec_id", "embedding", k=5, scale=256)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {"op5_hilbert_ann": op5_hilbert_ann, "op9_nra_topk": op9_nra_topk}
ORACLE_SQL = {
    "op9_nra_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, cast(list_dot_product(cast(a.q AS DOUBLE[]), cast(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
}
