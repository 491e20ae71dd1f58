"""Paper listings: filters, pages, children."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators.attach import attach, ordered_list
from folioscope.operators.paging import keyset_page, offset_page
from folioscope.plans.registry import Registry
from folioscope.plans.relations import authors, keywords, paper_authors, paper_keywords, papers, with_ctes

registry = Registry()
query = registry.query
NEWEST = [("published_date", True), ("id", True)]


def day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def named_authors(spark, sf_dir, page):
    """Author lists of the papers of a page only: the page is small, so it is sent to the links."""
    links = paper_authors(spark, sf_dir).join(F.broadcast(page.select(F.col("id").alias("paper_id"))), "paper_id", "left_semi")  # a page of limited size
    return ordered_list(links.join(authors(spark, sf_dir), "author_id"), "paper_id", F.struct("author_order", "author_id"), F.col("name"), "authors")


@query(
    with_ctes("papers", "paper_authors", "authors", more="""page AS (
  SELECT id, published_date, category FROM papers WHERE category IN ('1-URGENT', '2-HIGH')
    AND (published_date < DATE '2001-01-01' OR (published_date = DATE '2001-01-01' AND id < 500))
  ORDER BY published_date DESC, id DESC LIMIT 51),
first AS (SELECT * FROM page ORDER BY published_date DESC, id DESC LIMIT 50)""")
    + """SELECT f.id, strftime(f.published_date, '%Y-%m-%d') AS published_date, f.category,
       coalesce((SELECT string_agg(a.name, '; ' ORDER BY pa.author_order, pa.author_id) FROM paper_authors pa JOIN authors a USING (author_id) WHERE pa.paper_id = f.id), '') AS authors,
       (SELECT count(*) > 50 FROM page) AS has_more FROM first f"""
)
def list_recent_keyset(spark, sf_dir):
    wanted = papers(spark, sf_dir).where(F.col("category").isin("1-URGENT", "2-HIGH")).select("id", "published_date", "category")
    page = keyset_page(wanted, NEWEST, 50, [F.lit("2001-01-01").cast("date"), 500])
    whole = attach(page, named_authors(spark, sf_dir, page), "id", "paper_id", "authors")
    return whole.select("id", day("published_date"), "category", F.array_join("authors", "; ").alias("authors"), "has_more")


@query(with_ctes("papers", "paper_keywords", "keywords") + """SELECT id, strftime(published_date, '%Y-%m-%d') AS published_date FROM papers p
WHERE status = 'F' AND EXISTS (SELECT 1 FROM paper_keywords pk JOIN keywords k USING (keyword_id) WHERE pk.paper_id = p.id AND k.active AND k.score = 10)
ORDER BY p.published_date DESC, id DESC LIMIT 100""")  # fmt: skip
def list_filter_keyword_semi(spark, sf_dir):
    wanted = paper_keywords(spark, sf_dir).join(keywords(spark, sf_dir).where("active AND score = 10"), "keyword_id", "left_semi")
    found = papers(spark, sf_dir).where("status = 'F'").join(wanted, F.col("id") == F.col("paper_id"), "left_semi")
    return offset_page(found, [F.desc("published_date"), F.desc("id")], 1, 100).select("id", day("published_date"))


@query(with_ctes("papers") + """SELECT category, count(*) AS n, strftime(max(published_date), '%Y-%m-%d') AS latest FROM papers
WHERE published_date >= DATE '1999-01-01' AND published_date < DATE '2000-01-01' AND status IN ('F', 'O') GROUP BY category""")  # fmt: skip
def list_filter_year_range(spark, sf_dir):
    year = papers(spark, sf_dir).where("published_date >= DATE '1999-01-01' AND published_date < DATE '2000-01-01' AND status IN ('F', 'O')")
    return year.groupBy("category").agg(F.count("*").alias("n"), F.date_format(F.max("published_date"), "yyyy-MM-dd").alias("latest"))


@query(with_ctes("papers", "paper_authors", "authors", "paper_keywords", "keywords") + """SELECT id FROM papers p WHERE category LIKE '%URG%'
  OR EXISTS (SELECT 1 FROM paper_authors pa JOIN authors a USING (author_id) WHERE pa.paper_id = p.id AND a.name LIKE '%00007%')
  OR EXISTS (SELECT 1 FROM paper_keywords pk JOIN keywords k USING (keyword_id) WHERE pk.paper_id = p.id AND k.active AND k.phrase LIKE '%red ring%')""")  # fmt: skip
def list_query_or_exists(spark, sf_dir):
    by_author = paper_authors(spark, sf_dir).join(authors(spark, sf_dir).where("name LIKE '%00007%'"), "author_id").select("paper_id")
    by_keyword = paper_keywords(spark, sf_dir).join(keywords(spark, sf_dir).where("active AND phrase LIKE '%red ring%'"), "keyword_id").select("paper_id")
    linked = by_author.union(by_keyword).distinct().withColumn("hit", F.lit(True))
    joined = papers(spark, sf_dir).join(linked, F.col("id") == F.col("paper_id"), "left")
    return joined.where("category LIKE '%URG%' OR hit").select("id")


@query(with_ctes("papers") + "SELECT id, category, status, strftime(published_date, '%Y-%m-%d') AS published_date FROM papers WHERE id = 4242")
def get_by_id(spark, sf_dir):
    return papers(spark, sf_dir).where("id = 4242").select("id", "category", "status", day("published_date"))


@query(with_ctes("papers") + "SELECT id, strftime(published_date, '%Y-%m-%d') AS published_date FROM papers ORDER BY papers.published_date DESC, id DESC LIMIT 20 OFFSET 40")
def offset_page_three(spark, sf_dir):
    return offset_page(papers(spark, sf_dir), [F.desc("published_date"), F.desc("id")], 3, 20).select("id", day("published_date"))


@query(with_ctes("papers") + """SELECT id, category, status, (SELECT cast((count(*) + 19) // 20 AS BIGINT) FROM papers WHERE published_date = DATE '1998-03-04') AS pages
FROM papers WHERE published_date = DATE '1998-03-04'""")  # fmt: skip
def papers_on_date(spark, sf_dir):
    found = papers(spark, sf_dir).where("published_date = DATE '1998-03-04'").select("id", "category", "status")
    pages = found.agg(F.floor((F.count("*") + 19) / 20).alias("pages"))
    return found.join(F.broadcast(pages))  # one row


def _with_authors(spark, sf_dir, parents):
    links = paper_authors(spark, sf_dir).join(parents, "paper_id", "left_semi").join(authors(spark, sf_dir), "author_id")
    lists = ordered_list(links, "paper_id", F.struct("author_order", "author_id"), F.col("name"), "authors")
    return lists.select(F.col("paper_id").alias("id"), F.array_join("authors", "\t").alias("authors"), F.size("authors").cast("long").alias("n_authors"))


@query(with_ctes("papers", "paper_authors", "authors") + """SELECT paper_id AS id, string_agg(name, '\t' ORDER BY author_order, author_id) AS authors, count(*) AS n_authors
FROM paper_authors JOIN authors USING (author_id) JOIN papers ON papers.id = paper_id GROUP BY paper_id""")  # fmt: skip
def late_attach_authors_whole(spark, sf_dir):
    """Author lists of every paper that has authors."""
    return _with_authors(spark, sf_dir, papers(spark, sf_dir).select(F.col("id").alias("paper_id")))


@query(with_ctes("papers", "paper_keywords", "keywords") + """SELECT p.id, coalesce(string_agg(k.phrase || ':' || k.score || ':' || pk.source, ', ' ORDER BY k.score DESC, k.phrase, k.keyword_id), '') AS keywords
FROM papers p LEFT JOIN paper_keywords pk ON pk.paper_id = p.id LEFT JOIN keywords k ON k.keyword_id = pk.keyword_id AND k.active WHERE p.status = 'P' GROUP BY p.id""")  # fmt: skip
def attach_keywords_struct(spark, sf_dir):
    wanted = papers(spark, sf_dir).where("status = 'P'").select("id")
    links = paper_keywords(spark, sf_dir).join(wanted.select(F.col("id").alias("paper_id")), "paper_id", "left_semi").join(keywords(spark, sf_dir).where("active"), "keyword_id")
    shown = F.struct("phrase", "score", "source")
    lists = ordered_list(links, "paper_id", F.struct(-F.col("score"), "phrase", "keyword_id"), shown, "keywords")
    whole = attach(wanted, lists, "id", "paper_id", "keywords")
    return whole.select("id", F.array_join(F.transform("keywords", lambda k: F.concat_ws(":", k["phrase"], k["score"].cast("string"), k["source"])), ", ").alias("keywords"))


@query(with_ctes("papers") + "SELECT id, category FROM papers WHERE id >= (SELECT min(id) + cast(floor((max(id) - min(id) + 1) * 0.37) AS BIGINT) FROM papers) ORDER BY id LIMIT 1")
def random_paper(spark, sf_dir):
    """First id at or after a place in the id range; the draw (0.37) is a parameter."""
    p = papers(spark, sf_dir)
    place = p.agg((F.min("id") + F.floor((F.max("id") - F.min("id") + 1) * F.lit(0.37))).alias("place"))
    return p.join(F.broadcast(place), F.col("id") >= F.col("place")).orderBy("id").limit(1).select("id", "category")  # one row


registry.also("late_attach_authors", "late_attach_authors_whole")
