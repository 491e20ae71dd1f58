"""Free-form references read against records, and decisions renewed by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators.evidence import journal, reading_evidence, record_reading
from folioscope.operators.triage import reference_match
from folioscope.plans.registry import Registry
from folioscope.plans.relations import candidates, keywords, papers, with_ctes

registry = Registry()
query = registry.query

_REFERENCES = """refs AS (SELECT c.paper_id, c.doi_id, k.phrase, k.score AS volume, k.active,
  CASE WHEN p.id % 11 = 0 THEN 'Journal of Integer Sequences, ' ELSE '' END || 'J. of ' || k.phrase || ' ' || (1 + p.id % 10) || ' (' || year(p.published_date) || '), A' || (c.doi_id - p.id % 2) AS reference,
  cast(year(p.published_date) - c.doi_id % 2 AS VARCHAR) AS record_year
FROM candidates c JOIN papers p ON p.id = c.paper_id JOIN keywords k ON k.keyword_id = c.doi_id),
read AS (SELECT paper_id, doi_id, reference, contains(reference, record_year) AS year, contains(reference, ' ' || volume || ' ') AS volume,
  active AND contains(reference || '.', 'A' || doi_id || '.') AND length('A' || doi_id) >= 2 AS locator, active AS has_locator FROM refs),
matched AS (SELECT *, year AND (locator OR (NOT has_locator AND volume)) AS fits FROM read)"""


def _references(spark, sf_dir):
    """References made of papers' attributes, and records made of their candidates' keywords."""
    p = papers(spark, sf_dir).select(F.col("id").alias("paper_id"), F.year("published_date").alias("y"))
    k = keywords(spark, sf_dir).withColumnRenamed("keyword_id", "doi_id")
    pages = F.when(F.col("active"), F.array(F.concat(F.lit("A"), F.col("doi_id").cast("string"))))
    records = k.select("doi_id", "phrase", record_reading(F.array(F.col("score").cast("string")), pages, F.array(F.concat(F.lit("The J. of "), "phrase"))).alias("reading"))
    joined = candidates(spark, sf_dir).select("paper_id", "doi_id").join(p, "paper_id").join(records, "doi_id")
    known = F.when(F.col("paper_id") % 11 == 0, "Journal of Integer Sequences, ").otherwise("")
    reference = F.concat(known, F.lit("J. of "), "phrase", F.lit(" "), (1 + F.col("paper_id") % 10).cast("string"), F.lit(" ("), F.col("y").cast("string"), F.lit("), A"), (F.col("doi_id") - F.col("paper_id") % 2).cast("string"))
    seen = reading_evidence(F.col("reference"), F.array((F.col("y") - F.col("doi_id") % 2).cast("string")), F.col("reading"))
    read = joined.withColumn("reference", reference).select("paper_id", "doi_id", "reference", seen.alias("e"))
    return read.select("paper_id", "doi_id", "reference", "e.*")


@query(with_ctes("candidates", "papers", "keywords", more=_REFERENCES) + "SELECT paper_id, doi_id, year, volume, locator, has_locator, fits FROM matched")
def reference_reading(spark, sf_dir):
    """Years, volumes, pages and journals read from references; each record here is in its own journal."""
    fits = reference_match(F.col("year"), F.col("volume"), F.col("locator"), F.col("has_locator"), F.col("container"))
    return _references(spark, sf_dir).select("paper_id", "doi_id", "year", "volume", "locator", "has_locator", fits.alias("fits"))


@query(with_ctes("candidates", "papers", "keywords", more=_REFERENCES) + """SELECT CASE WHEN contains(reference, 'Integer') THEN 'skip_known_doi_less' WHEN fits THEN 'approve_journal_reference' ELSE 'unresolved' END AS decision, count(*) AS n FROM matched GROUP BY ALL""")
def journal_decisions(spark, sf_dir):
    """How references decide on candidates that were unresolved, with sure titles and authors."""
    fits = reference_match(F.col("year"), F.col("volume"), F.col("locator"), F.col("has_locator"), F.col("container"))
    sure = F.lit(1.0)
    decided = journal(F.lit("unresolved"), F.col("reference"), F.lit(False), F.lit(True), fits, sure, sure)
    return _references(spark, sf_dir).groupBy(decided.alias("decision")).agg(F.count("*").alias("n"))
