"""One keyword tagged anew from stored postings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.operators.fulltext import tokens
from folioscope.operators.postings import Postings, retag
from folioscope.operators.stored import shared_folder
from folioscope.plans.registry import Registry
from folioscope.plans.relations import table, texts

registry = Registry()
query = registry.query

PHRASE, KEYWORD = "the and", 3


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: true) AS toks FROM documents WHERE doc_id % 11 <> 0),
hits AS (SELECT doc_id AS id FROM t WHERE contains(' ' || array_to_string(toks, ' ') || ' ', ' the and ')),
links AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 3 ELSE 4 END AS keyword_id, CASE WHEN toxic = 1 THEN 'N' ELSE 'A' END AS source FROM labels),
kept AS (SELECT * FROM links WHERE NOT (keyword_id = 3 AND source = 'A'))
SELECT * FROM kept UNION ALL SELECT DISTINCT id, 3, 'A' FROM hits WHERE id NOT IN (SELECT id FROM kept WHERE keyword_id = 3)""")  # fmt: skip
def retag_one_keyword(spark, sf_dir):
    """All links after one keyword was tagged anew: an index over all documents, a batch of which went, some of them to come back."""
    index = Postings(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
    docs = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("words"))
    index.add(docs, batch=1)
    index.take_away(docs.where("id % 11 = 0 OR id % 13 = 0").select("id"), batch=2)
    index.add(docs.where("id % 13 = 0 AND id % 11 <> 0"), batch=3)
    labels = table(spark, sf_dir, "labels")
    links = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, KEYWORD).otherwise(4).alias("keyword_id"), F.when(F.col("toxic") == 1, "N").otherwise("A").alias("source"))
    return retag(links, KEYWORD, index.phrase(PHRASE))
