"""Search: ranked substring search, full text, author terms, match labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators.fulltext import holds_any, scored, tokens
from folioscope.plans.registry import Registry
from folioscope.plans.relations import authors, keywords, paper_authors, paper_keywords, papers, table, texts, with_ctes

registry = Registry()
query = registry.query

_TOKENS = "t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents)"


@query(with_ctes("papers", "paper_authors", "authors", "paper_keywords", "keywords", more="""am AS (SELECT DISTINCT paper_id FROM paper_authors JOIN authors USING (author_id) WHERE name LIKE '%0042%'),
kw AS (SELECT paper_id, sum(score) AS s, bool_or(active AND phrase LIKE '%gear%') AS hit FROM paper_keywords JOIN keywords USING (keyword_id) GROUP BY paper_id)""") + """
SELECT id, am.paper_id IS NOT NULL AS author_match, coalesce(kw.hit, false) AS keyword_match, CASE WHEN category LIKE '%HIGH%' THEN 2 WHEN status = 'F' THEN 1 ELSE 0 END AS text_score,
       cast(coalesce(kw.s, 0) AS BIGINT) AS kw_score FROM papers LEFT JOIN am ON am.paper_id = id LEFT JOIN kw ON kw.paper_id = id
WHERE am.paper_id IS NOT NULL OR kw.hit OR category LIKE '%HIGH%'
ORDER BY author_match DESC, keyword_match DESC, text_score DESC, kw_score DESC, published_date DESC, id DESC LIMIT 60""")  # fmt: skip
def search_like_ranked(spark, sf_dir):
    """Signals are aggregated before they are joined; the keyword score also counts inactive keywords."""
    by_author = paper_authors(spark, sf_dir).join(authors(spark, sf_dir).where("name LIKE '%0042%'"), "author_id").select(F.col("paper_id").alias("a_id")).distinct()
    links = paper_keywords(spark, sf_dir).join(keywords(spark, sf_dir), "keyword_id")
    by_keyword = links.groupBy(F.col("paper_id").alias("k_id")).agg(F.sum("score").alias("s"), F.bool_or(F.expr("active AND phrase LIKE '%gear%'")).alias("hit"))
    p = papers(spark, sf_dir)
    joined = p.join(by_author, p.id == F.col("a_id"), "left").join(by_keyword, p.id == F.col("k_id"), "left")
    shown = joined.select(
        "id", "published_date", F.col("a_id").isNotNull().alias("author_match"), F.coalesce("hit", F.lit(False)).alias("keyword_match"),
        F.when(F.col("category").like("%HIGH%"), 2).when(F.col("status") == "F", 1).otherwise(0).alias("text_score"),
        F.coalesce("s", F.lit(0)).alias("kw_score"), F.col("category").like("%HIGH%").alias("in_text"),
    )
    found = shown.where("author_match OR keyword_match OR in_text")
    order = [F.desc(c) for c in ("author_match", "keyword_match", "text_score", "kw_score", "published_date", "id")]
    return found.orderBy(*order).limit(60).drop("published_date", "in_text")


@query(f"WITH {_TOKENS}" + """, df AS (SELECT count(*) AS n, count_if(list_contains(toks, 'the')) AS d0, count_if(list_contains(toks, 'with')) AS d1 FROM t)
SELECT doc_id, round(len(list_filter(toks, lambda x: x = 'the')) * log10(n / d0) * log10(n / d0) + len(list_filter(toks, lambda x: x = 'with')) * log10(n / d1) * log10(n / d1), 6) AS text_score
FROM t, df WHERE list_contains(toks, 'the') AND list_contains(toks, 'with') ORDER BY text_score DESC, doc_id DESC LIMIT 100""")  # fmt: skip
def search_fulltext_boolean(spark, sf_dir):
    found = scored(texts(spark, sf_dir).select("doc_id", "text"), F.col("text"), ["the", "with"])
    return found.select("doc_id", "text_score").orderBy(F.desc("text_score"), F.desc("doc_id")).limit(100)


@query(f"WITH {_TOKENS} SELECT doc_id FROM t WHERE list_has_any(toks, ['license', 'password', 'general'])")
def search_fulltext_natural(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("toks"))
    return docs.where(holds_any(F.col("toks"), ["license", "password", "general"])).select("doc_id")


@query(with_ctes("paper_authors", "authors") + """SELECT paper_id FROM paper_authors JOIN authors USING (author_id) GROUP BY paper_id
HAVING bool_or(lower(name) LIKE '%01%') AND bool_or(lower(name) LIKE '%7%') AND bool_or(lower(name) LIKE '%33%')""")  # fmt: skip
def search_author_all_terms(spark, sf_dir):
    """Every term must be in the name of some author, not of the same one: one aggregation for all terms."""
    links = paper_authors(spark, sf_dir).join(authors(spark, sf_dir), "author_id")
    name = F.lower("name")
    hits = [F.bool_or(name.contains(term)).alias(f"t{i}") for i, term in enumerate(("01", "7", "33"))]
    return links.groupBy("paper_id").agg(*hits).where("t0 AND t1 AND t2").select("paper_id")


def _highlighted(spark, sf_dir, part):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        part = F.regexp_replace(part, raw, safe)
    return texts(spark, sf_dir).where("lang = 'en'").select("doc_id", F.regexp_replace(part, "(?i)(thhe|the)", "<mark>$1</mark>").alias("shown"))


@query("""SELECT doc_id, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(thhe|the)', '<mark>\\1</mark>', 'g') AS shown FROM documents WHERE lang = 'en'""")
def search_highlight_whole(spark, sf_dir):
    """Marks the terms, longest first, in escaped whole texts."""
    return _highlighted(spark, sf_dir, F.col("text"))


@query("""SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(regexp_extract(html, '<title>([^<]*)', 1), '(?i)the') THEN 'title' END, CASE WHEN regexp_matches(regexp_extract(url, '://([^/]+)', 1), '(?i)a') THEN 'author' END,
CASE WHEN regexp_matches(html, '(?i)licensed') THEN 'keyword' END, CASE WHEN regexp_matches(html, '(?i)the') THEN 'abstract' END], lambda x: x IS NOT NULL), ',') AS labels FROM pages""")  # fmt: skip
def search_match_labels_whole(spark, sf_dir):
    """Where a page matched, by its whole title, in a fixed order."""
    label = lambda c, pattern, name: F.when(c.rlike(f"(?i){pattern}"), name)
    part = lambda c, pattern: F.regexp_extract(c, pattern, 1)
    shown = F.array(label(part("html", "<title>([^<]*)"), "the", "title"), label(part("url", "://([^/]+)"), "a", "author"), label(F.col("html"), "licensed", "keyword"), label(F.col("html"), "the", "abstract"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_compact(shown), ",").alias("labels"))


registry.also("search_highlight", "search_highlight_whole")
registry.also("search_match_labels", "search_match_labels_whole")
