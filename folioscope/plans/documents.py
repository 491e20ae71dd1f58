"""All papers as nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.documents import LABEL_SITE, document, with_targets
from folioscope.operators.attach import ordered_list
from folioscope.plans.registry import Registry
from folioscope.plans.relations import authors, keywords, paper_authors, paper_keywords, papers, with_ctes

registry = Registry()
query = registry.query


@query(with_ctes("papers", "paper_authors", "authors", "paper_keywords", "keywords") + f""", labels AS (SELECT DISTINCT replace(phrase, ' ', '_') AS label, phrase FROM keywords WHERE phrase < 'n'),
links AS (SELECT pk.paper_id, pk.keyword_id, k.phrase, k.score, pk.source, CASE k.keyword_id % 4 WHEN 0 THEN replace(k.phrase, ' ', '_') WHEN 1 THEN '{LABEL_SITE}/' || (k.keyword_id % 10) WHEN 2 THEN 'https://elsewhere.org/' || k.keyword_id END AS url
  FROM paper_keywords pk JOIN keywords k USING (keyword_id)),
aimed AS (SELECT l.*, CASE WHEN l.url LIKE '{LABEL_SITE}/%' THEN {{'label': l.url, 'title': l.phrase, 'url': l.url}} WHEN b.label IS NOT NULL THEN {{'label': b.label, 'title': 'The ' || b.phrase, 'url': '{LABEL_SITE}/' || b.label || '.htm'}} END AS target FROM links l LEFT JOIN labels b ON b.label = l.url),
kw AS (SELECT paper_id, list({{'phrase': phrase, 'score': score, 'source': source, 'reference': url, 'target': target}} ORDER BY score DESC, phrase, keyword_id) AS keywords, list(target ORDER BY score DESC, phrase, keyword_id) AS all_targets FROM aimed GROUP BY ALL),
au AS (SELECT paper_id, list(name ORDER BY author_order, author_id) AS authors FROM paper_authors JOIN authors USING (author_id) GROUP BY ALL),
p AS (SELECT id, '24' || lpad(cast(id % 100 AS VARCHAR), 2, '0') || '.' || lpad(cast(id AS VARCHAR), 9, '0') AS base, 1 + id % 3 AS version, category, published_date, status, coalesce(authors, []) AS authors, coalesce(keywords, []) AS keywords,
  list_filter(coalesce(all_targets, []), lambda t: t IS NOT NULL) AS found FROM papers LEFT JOIN au ON au.paper_id = id LEFT JOIN kw ON kw.paper_id = id)
SELECT id, cast(to_json({{'arxiv_id': base, 'arxiv_version': version, 'versioned_arxiv_id': base || 'v' || version, 'title': category, 'abstract': NULL, 'authors': authors, 'primary_category': status, 'categories': [status], 'keywords': keywords,
  'targets': list_filter(found, lambda t, i: list_position(list_transform(found, lambda u: u.label), t.label) = i), 'published_at': cast(published_date AS VARCHAR), 'revised_at': NULL, 'ingested_at': strftime(published_date, '%Y-%m-%dT00:00:00Z'), 'changed_at': NULL, 'comment': NULL,
  'publication': {{'journal_reference': NULL, 'doi': CASE WHEN status = 'F' THEN '10.1/' || id END, 'doi_status': CASE WHEN status = 'F' THEN 'verified' END, 'url': NULL, 'venue_key': NULL, 'status': NULL, 'editor_note': NULL}},
  'urls': {{'site': 'https://papers.example.org/paper/' || base, 'arxiv': 'https://arxiv.org/abs/' || base || 'v' || version, 'pdf': 'https://arxiv.org/pdf/' || base || 'v' || version}}}}) AS VARCHAR) AS document FROM p""")  # fmt: skip
def paper_documents(spark, sf_dir):
    """Every paper with its authors, keywords and label targets as JSON."""
    k, p = keywords(spark, sf_dir), papers(spark, sf_dir)
    labels = k.where("phrase < 'n'").select(F.replace("phrase", F.lit(" "), F.lit("_")).alias("label"), F.concat(F.lit("The "), "phrase").alias("title")).distinct().withColumn("href", F.concat(F.lit("/"), "label", F.lit(".htm")))
    id_ = F.col("keyword_id")
    url = F.when(id_ % 4 == 0, F.replace("phrase", F.lit(" "), F.lit("_"))).when(id_ % 4 == 1, F.concat(F.lit(f"{LABEL_SITE}/"), id_ % 10)).when(id_ % 4 == 2, F.concat(F.lit("https://elsewhere.org/"), id_))
    links = paper_keywords(spark, sf_dir).join(with_targets(k.withColumn("url", url), labels), "keyword_id")
    keyword_lists = ordered_list(links, "paper_id", F.struct(-F.col("score"), "phrase", "keyword_id"), F.struct("phrase", "score", "source", "url", "target"), "keywords")
    author_lists = ordered_list(paper_authors(spark, sf_dir).join(authors(spark, sf_dir), "author_id"), "paper_id", F.struct("author_order", "author_id"), F.col("name"), "authors")
    base = F.concat(F.lit("24"), F.lpad((F.col("id") % 100).cast("string"), 2, "0"), F.lit("."), F.lpad(F.col("id").cast("string"), 9, "0"))
    null = F.lit(None).cast("string")
    rows = p.withColumns({"base_id": base, "version": (1 + F.col("id") % 3).cast("int")}).withColumn("arxiv_id", F.concat("base_id", F.lit("v"), "version"))
    verified = F.col("status") == "F"
    rows = rows.withColumns({c: null for c in ("abstract", "comment", "journal_ref", "publication_url", "publication_venue_key", "publication_status", "editor_note")})
    rows = rows.withColumns({"title": F.col("category"), "primary_category": F.col("status"), "categories": F.array("status"), "updated_date": F.lit(None).cast("date"), "created_at": F.to_timestamp(F.concat(F.col("published_date").cast("string"), F.lit("T00:00:00Z"))), "updated_at": F.lit(None).cast("timestamp"), "doi": F.when(verified, F.concat(F.lit("10.1/"), "id")), "doi_status": F.when(verified, "verified")})
    whole = rows.join(author_lists.withColumnRenamed("paper_id", "id"), "id", "left").join(keyword_lists.withColumnRenamed("paper_id", "id"), "id", "left")
    return whole.select("id", F.to_json(document(), {"ignoreNullFields": "false"}).alias("document"))
