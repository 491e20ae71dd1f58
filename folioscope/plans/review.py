"""Review of identifiers, and listings by switches, as joins and transitions over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.plans.registry import Registry
from folioscope.plans.relations import AS_OF, candidates, keywords, paper_authors, paper_keywords, papers, users, with_ctes

registry = Registry()
query = registry.query

#: Orders of a listing by name: columns and whether they fall.
ORDERS = {"newest": [("published_date", True), ("id", True)], "oldest": [("published_date", False), ("id", False)], "dearest": [("amount", True), ("id", True)]}


def in_order(order: str) -> list:
    """Sort columns of the named order; an unknown name is an error, never a silent default."""
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}; one of {sorted(ORDERS)}")
    return [F.desc(c) if falls else F.asc(c) for c, falls in ORDERS[order]]


@query(with_ctes("papers", more="""ranked AS (
SELECT 'newest' AS ordering, id, row_number() OVER (ORDER BY published_date DESC, id DESC) AS place FROM papers UNION ALL
SELECT 'oldest', id, row_number() OVER (ORDER BY published_date, id) FROM papers UNION ALL
SELECT 'dearest', id, row_number() OVER (ORDER BY amount DESC, id DESC) FROM papers)""") + "SELECT ordering, id, cast(place AS INTEGER) AS place FROM ranked WHERE place <= 25")  # fmt: skip
def sort_switch(spark, sf_dir):
    """The first page in each order: a bounded top-k for each, never a sort of the table."""
    pages = []
    for order in ORDERS:
        top = papers(spark, sf_dir).orderBy(*in_order(order)).limit(25)
        place = F.row_number().over(Window.partitionBy(F.lit(order)).orderBy(*in_order(order))).cast("int")
        pages.append(top.withColumn("place", place).select(F.lit(order).alias("ordering"), "id", "place"))
    return pages[0].union(pages[1]).union(pages[2])


@query(with_ctes("papers", "candidates") + """SELECT p.id, c.doi_id FROM papers p LEFT JOIN candidates c ON c.paper_id = p.id AND c.approved
WHERE c.doi_id IS NULL OR NOT EXISTS (SELECT 1 FROM candidates r WHERE r.paper_id <> p.id AND r.doi_id = c.doi_id AND NOT r.approved AND r.confidence < 20)""")  # fmt: skip
def rejected_elsewhere_anti(spark, sf_dir):
    """Papers with their approved identifiers, but for those that were rejected for another paper; papers without any stay.

    Whether another paper rejected an identifier follows from the least and greatest rejecting paper: one row for
    each identifier is joined, not one for each pair of papers.
    """
    c = candidates(spark, sf_dir)
    rejected = c.where("NOT approved AND confidence < 20").groupBy("doi_id").agg(F.min("paper_id").alias("low"), F.max("paper_id").alias("high"))
    own = papers(spark, sf_dir).select("id").join(c.where("approved").select(F.col("paper_id").alias("id"), "doi_id"), "id", "left")
    judged = own.where("doi_id IS NOT NULL").join(rejected, "doi_id", "left").where("low IS NULL OR (low = id AND high = id)")
    return judged.select("id", "doi_id").union(own.where("doi_id IS NULL").select("id", "doi_id"))


@query(with_ctes("candidates") + """SELECT paper_id, doi_id FROM candidates c WHERE approved AND confidence >= 95
AND EXISTS (SELECT 1 FROM candidates o WHERE o.doi_id = c.doi_id AND o.paper_id <> c.paper_id AND o.approved AND o.confidence >= 95)""")  # fmt: skip
def assigned_twice(spark, sf_dir):
    """Sure identifiers that another paper has, too: a count for each identifier takes the place of the unequal join."""
    sure = candidates(spark, sf_dir).where("approved AND confidence >= 95").select("paper_id", "doi_id")
    return sure.join(sure.groupBy("doi_id").agg(F.count("*").alias("n")).where("n > 1").select("doi_id"), "doi_id", "left_semi")


@query(with_ctes("papers", "paper_authors", more="""kept AS (
SELECT user_id, max(id) AS keep_id FROM papers GROUP BY user_id), links AS (
SELECT k.keep_id, a.paper_id, a.author_id FROM paper_authors a JOIN papers p ON p.id = a.paper_id JOIN kept k ON k.user_id = p.user_id)""") + """
SELECT keep_id, author_id, count(*) AS links, max(cast(paper_id = keep_id AS INTEGER)) AS own FROM links GROUP BY keep_id, author_id""")  # fmt: skip
def merge_child_links(spark, sf_dir):
    """Links of merged papers re-keyed to the one that stays: a link it has already is not made twice (own tells)."""
    p = papers(spark, sf_dir)
    kept = p.groupBy("user_id").agg(F.max("id").alias("keep_id"))
    by_paper = p.select("user_id", F.col("id").alias("paper_id")).join(kept, "user_id").select("paper_id", "keep_id")
    links = paper_authors(spark, sf_dir).join(by_paper, "paper_id")
    return links.groupBy("keep_id", "author_id").agg(F.count("*").alias("links"), F.max((F.col("paper_id") == F.col("keep_id")).cast("int")).alias("own"))


@query(with_ctes("papers", "paper_keywords", "keywords", "users") + """SELECT u.segment, k.score, count(*) AS links, count(DISTINCT p.id) AS papers
FROM users u JOIN papers p ON p.user_id = u.user_id JOIN paper_keywords pk ON pk.paper_id = p.id JOIN keywords k ON k.keyword_id = pk.keyword_id AND k.active
GROUP BY u.segment, k.score""")  # fmt: skip
def four_way_chain(spark, sf_dir):
    """Users, papers, links and keywords in one chain; the narrow sides are left to the planner's own size checks."""
    chain = users(spark, sf_dir).join(papers(spark, sf_dir).select("id", "user_id"), "user_id")
    chain = chain.join(paper_keywords(spark, sf_dir).select(F.col("paper_id").alias("id"), "keyword_id"), "id")
    chain = chain.join(keywords(spark, sf_dir).where("active").select("keyword_id", "score"), "keyword_id")
    return chain.groupBy("segment", "score").agg(F.count("*").alias("links"), F.countDistinct("id").alias("papers"))


@query(with_ctes("paper_keywords", more="used AS (SELECT keyword_id, count(*) AS n, min(paper_id) AS first_seen FROM paper_keywords GROUP BY keyword_id)") + """
SELECT keyword_id, n, cast(row_number() OVER (ORDER BY n DESC, first_seen, keyword_id) AS INTEGER) AS place FROM used QUALIFY place <= 200""")  # fmt: skip
def counts_first_seen(spark, sf_dir):
    """The most used keywords; of equal counts the one seen first is first. A report of 200 rows."""
    order = [F.desc("n"), F.asc("first_seen"), F.asc("keyword_id")]
    used = paper_keywords(spark, sf_dir).groupBy("keyword_id").agg(F.count("*").alias("n"), F.min("paper_id").alias("first_seen"))
    top = used.orderBy(*order).limit(200)
    return top.select("keyword_id", "n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("int").alias("place"))


@query(with_ctes("candidates", more="""decided AS (SELECT paper_id, doi_id, confidence,
CASE WHEN approved AND confidence >= 50 THEN 'approved' WHEN confidence < 20 THEN 'rejected' WHEN seen > 1 THEN 'skipped' ELSE 'pending' END AS state FROM candidates)""") + """
SELECT paper_id, count(*) FILTER (state = 'approved') AS approved, count(*) FILTER (state = 'rejected') AS rejected, count(*) FILTER (state = 'skipped') AS skipped,
count(*) FILTER (state = 'pending') AS pending, max(CASE WHEN state = 'approved' THEN confidence * 1000000000 + doi_id END) % 1000000000 AS doi_id FROM decided GROUP BY paper_id""")  # fmt: skip
def candidate_decisions(spark, sf_dir):
    """Decisions on candidates applied to papers: the surest approved identifier becomes the paper's, the others' states are counted."""
    state = F.when(F.col("approved") & (F.col("confidence") >= 50), "approved").when(F.col("confidence") < 20, "rejected").when(F.col("seen") > 1, "skipped").otherwise("pending")
    decided = candidates(spark, sf_dir).withColumn("state", state)
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("approved", "rejected", "skipped", "pending")]
    best = F.max(F.when(F.col("state") == "approved", F.struct("confidence", "doi_id")))["doi_id"]
    return decided.groupBy("paper_id").agg(*counts, best.alias("doi_id"))


@query(with_ctes("papers", "candidates", more="checked AS (SELECT paper_id, max(confidence) AS best, count(*) AS tries FROM candidates GROUP BY paper_id)") + f"""
SELECT p.id, coalesce(c.tries, 0) AS tries, cast(date_diff('day', p.published_date, DATE '{AS_OF}') AS INTEGER) AS age FROM papers p LEFT JOIN checked c ON c.paper_id = p.id
WHERE date_diff('day', p.published_date, DATE '{AS_OF}') >= 90 * (1 + coalesce(c.tries, 0)) AND coalesce(c.best, 0) < 100""")  # fmt: skip
def recheck_due(spark, sf_dir):
    """Papers whose last look-up is too long ago; each try makes the time to the next longer."""
    checked = candidates(spark, sf_dir).groupBy(F.col("paper_id").alias("id")).agg(F.max("confidence").alias("best"), F.count("*").alias("tries"))
    age = F.date_diff(F.lit(AS_OF).cast("date"), F.col("published_date")).alias("age")
    looked = papers(spark, sf_dir).select("id", age).join(checked, "id", "left").fillna(0, ["best", "tries"])
    return looked.where("age >= 90 * (1 + tries) AND best < 100").select("id", "tries", "age")
