"""Where a search goes: to a paper, an author, a keyword, the papers of a citation key, or to full text."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.bibtex import search_key
from folioscope.operators.cascade import first_stage
from folioscope.plans.registry import Registry
from folioscope.plans.relations import authors, keywords, paper_authors, papers, parts, with_ctes

registry = Registry()
query = registry.query


def citation_keys(spark, sf_dir):
    """(key, target): each paper's lower-case citation keys, as published and as preprint, by its authors in order."""
    named = paper_authors(spark, sf_dir).join(authors(spark, sf_dir), "author_id").repartition(parts(spark, sf_dir, "lineitem"), "paper_id")
    last = F.regexp_replace(F.lower(F.substring_index(F.trim("name"), " ", -1)), r"[^\p{L}\p{N}]", "")
    placed = F.sort_array(F.collect_list(F.struct("author_order", "author_id", last.alias("last"))))
    lists = named.groupBy("paper_id").agg(F.array_join(F.transform(placed, lambda a: a["last"]), "").alias("names"))
    keyed = lists.join(papers(spark, sf_dir).select(F.col("id").alias("paper_id"), F.year("published_date").alias("y")), "paper_id")
    forms = F.explode(F.array(*(F.concat("names", F.col("y").cast("string"), F.lit(end)) for end in ("", "x"))))
    return keyed.select(forms.alias("key"), F.col("paper_id").alias("target"))


def route(spark, sf_dir, asked):
    """asked (a column q) with the stage that answers each search and its target; blanks around a search don't count.

    In order: a paper's number, an author's name in any case, an active keyword, a citation key; all else is text,
    and an empty or null search is none. All searches go through each stage as one join.
    """
    q = F.trim("q")
    number = F.regexp_extract(q, r"(?i)^(?:paper:\s*)?([0-9]{1,18})$", 1).try_cast("long")
    keys = asked.withColumns({"_number": number, "_name": F.lower(q), "_cited": search_key(q)["key"]})
    by_name = authors(spark, sf_dir).select(F.lower("name").alias("key"), F.col("author_id").alias("target"))
    by_phrase = keywords(spark, sf_dir).where("active").select(F.col("phrase").alias("key"), F.col("keyword_id").alias("target"))
    stages = [
        ("paper", "_number", papers(spark, sf_dir).select(F.col("id").alias("key"), F.col("id").alias("target"))),
        ("author", "_name", by_name),
        ("keyword", "_name", by_phrase),
        ("citation", "_cited", citation_keys(spark, sf_dir)),
    ]
    routed = first_stage(keys, stages, "text", parts(spark, sf_dir, "lineitem")).drop("_number", "_name", "_cited")
    return routed.withColumn("stage", F.when(F.coalesce(q, F.lit("")) == "", "none").otherwise(F.col("stage")))


@query(with_ctes("papers", "authors", "keywords", "paper_authors", more="""asked AS (
SELECT ' Paper: ' || (id * 2) AS q FROM papers UNION ALL SELECT upper(name) FROM authors UNION ALL SELECT upper(phrase) FROM keywords UNION ALL SELECT '  '
UNION ALL SELECT '@article{Supplier' || regexp_extract(name, '[0-9]+$') || '1995x, title' FROM authors),
cited AS (SELECT paper_id, string_agg(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), '' ORDER BY author_order, author_id) || year(any_value(published_date)) || 'x' AS key
FROM paper_authors JOIN authors USING (author_id) JOIN papers ON id = paper_id GROUP BY paper_id),
c AS (SELECT key, min(paper_id) AS target FROM cited GROUP BY key), n AS (SELECT lower(name) AS key, min(author_id) AS target FROM authors GROUP BY ALL),
k AS (SELECT phrase AS key, min(keyword_id) AS target FROM keywords WHERE active GROUP BY ALL),
routed AS (SELECT q, CASE WHEN trim(q) = '' THEN 'none' WHEN id IS NOT NULL THEN 'paper' WHEN n.key IS NOT NULL THEN 'author' WHEN k.key IS NOT NULL THEN 'keyword' WHEN c.key IS NOT NULL THEN 'citation' ELSE 'text' END AS stage,
  coalesce(id, n.target, k.target, c.target) AS target FROM asked LEFT JOIN papers ON id = try_cast(regexp_extract(q, '^ Paper: ([0-9]+)$', 1) AS BIGINT)
  LEFT JOIN n ON n.key = lower(q) LEFT JOIN k ON k.key = lower(q) LEFT JOIN c ON c.key = lower(regexp_extract(q, '[{]([^,]+),', 1)))""") + """
SELECT q, stage, cast(target AS VARCHAR) AS target FROM routed""")  # fmt: skip
def search_routes(spark, sf_dir):
    """The stage that answers each of many searches: numbers (half of them of no paper), names, phrases, citation keys, nothing."""
    a = authors(spark, sf_dir)
    number = papers(spark, sf_dir).select(F.concat(F.lit(" Paper: "), (F.col("id") * 2).cast("string")).alias("q"))
    cited = a.select(F.concat(F.lit("@article{Supplier"), F.regexp_extract("name", "[0-9]+$", 0), F.lit("1995x, title")).alias("q"))
    asked = number.union(a.select(F.upper("name"))).union(keywords(spark, sf_dir).select(F.upper("phrase"))).union(spark.createDataFrame([("  ",)], "q string")).union(cited)
    return route(spark, sf_dir, asked)
