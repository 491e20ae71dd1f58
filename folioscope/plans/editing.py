"""One listing call with all filters, what is shown of papers, and editors' changes to identifiers, keywords and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.display import author_line, author_terms, clean_title, confidence_text, highlight_terms
from folioscope.operators.attach import attach, ordered_list
from folioscope.operators.paging import all_of, decode_cursor, encode_cursor, keyset_page
from folioscope.plans.listings import named_authors
from folioscope.plans.registry import Registry
from folioscope.plans.relations import AS_OF, activity, authors, candidates, keywords, paper_authors, paper_keywords, papers, table, with_ctes
from folioscope.plans.review import ORDERS, in_order

registry = Registry()
query = registry.query


def find_papers(spark, sf_dir, *, limit=50, order="newest", cursor=None, published_after=None, category=None, keyword=None, text=None):
    """One page of papers by every filter that is given, with authors and has_more.

    Keyword and text are semi joins, so a paper with many hits is one row. The cursor is that of encode_cursor for
    the order; one of another order is refused. Authors are attached to the page, not to what was filtered.
    """
    in_order(order)
    p = papers(spark, sf_dir)
    found = p.where(all_of([F.col(c) >= F.lit(v).cast("date") for c, v in [("published_date", published_after)] if v] + [F.col(c) == v for c, v in [("category", category)] if v]))
    if keyword is not None:
        held = paper_keywords(spark, sf_dir).join(keywords(spark, sf_dir).where(F.col("active") & (F.col("phrase") == keyword)), "keyword_id", "left_semi")
        found = found.join(held, F.col("id") == F.col("paper_id"), "left_semi")
    if text is not None:
        by_author = paper_authors(spark, sf_dir).join(authors(spark, sf_dir).where(F.col("name").contains(text)), "author_id", "left_semi").select("paper_id")
        by_keyword = paper_keywords(spark, sf_dir).join(keywords(spark, sf_dir).where(F.col("active") & F.col("phrase").contains(text)), "keyword_id", "left_semi").select("paper_id")
        linked = by_author.union(by_keyword).distinct().withColumn("hit", F.lit(True))
        found = found.join(linked, F.col("id") == F.col("paper_id"), "left").where(F.col("category").contains(text) | F.col("hit"))
    after = None
    if cursor is not None:
        value, row_id = decode_cursor(cursor, order)
        after = [F.lit(value).cast(p.schema[ORDERS[order][0][0]].dataType), row_id]
    page = keyset_page(found.select("id", "published_date", "category", "amount"), ORDERS[order], limit, after)
    whole = attach(page, named_authors(spark, sf_dir, page), "id", "paper_id", "authors")
    return whole.select("id", F.date_format("published_date", "yyyy-MM-dd").alias("published_date"), "category", F.array_join("authors", "; ").alias("authors"), "has_more")


_SHOWN = """SELECT f.id, strftime(f.published_date, '%Y-%m-%d') AS published_date, f.category,
  coalesce((SELECT string_agg(a.name, '; ' ORDER BY pa.author_order, pa.author_id) FROM paper_authors pa JOIN authors a USING (author_id) WHERE pa.paper_id = f.id), '') AS authors,
  (SELECT count(*) > {0} FROM page) AS has_more FROM (SELECT * FROM page ORDER BY published_date DESC, id DESC LIMIT {0}) f"""


@query(with_ctes("papers", "paper_authors", "authors", "paper_keywords", "keywords", more="""hits AS (
SELECT paper_id FROM paper_authors JOIN authors USING (author_id) WHERE name LIKE '%gear%' UNION SELECT paper_id FROM paper_keywords JOIN keywords USING (keyword_id) WHERE active AND phrase LIKE '%gear%'),
page AS (SELECT id, published_date, category FROM papers WHERE published_date >= DATE '1996-01-01' AND category = '2-HIGH'
  AND (published_date < DATE '2001-01-01' OR (published_date = DATE '2001-01-01' AND id < 500)) AND (category LIKE '%gear%' OR id IN (SELECT paper_id FROM hits))
  ORDER BY published_date DESC, id DESC LIMIT 41)""") + _SHOWN.format(40))  # fmt: skip
def list_papers_filtered(spark, sf_dir):
    return find_papers(spark, sf_dir, limit=40, cursor=encode_cursor("newest", "2001-01-01", 500), published_after="1996-01-01", category="2-HIGH", text="gear")


@query(with_ctes("papers", "paper_authors", "authors", more=f"page AS (SELECT id, published_date, category FROM papers WHERE published_date >= DATE '{AS_OF}' - INTERVAL 30 DAY ORDER BY published_date DESC, id DESC LIMIT 101)") + _SHOWN.format(100))
def list_papers_last_days(spark, sf_dir, days=30):
    """Papers of the last days before AS_OF, as the first page of the one listing call."""
    from datetime import date, timedelta

    return find_papers(spark, sf_dir, limit=100, published_after=str(date.fromisoformat(AS_OF) - timedelta(days=days)))


@query(with_ctes("paper_authors", "authors", more="""placed AS (SELECT paper_id, lower('A' || author_id || ' ' || split_part(name, '#', 1)) AS shown,
row_number() OVER (PARTITION BY paper_id ORDER BY author_order, author_id) AS place FROM paper_authors JOIN authors USING (author_id))""") + """
SELECT paper_id, string_agg(shown, ', ' ORDER BY place) FILTER (place <= 3) || CASE WHEN max(place) > 3 THEN ' et al.' ELSE '' END AS line FROM placed GROUP BY paper_id""")  # fmt: skip
def author_lines(spark, sf_dir):
    """Short author lines of every paper; the names are given as 'Last, First'."""
    named = F.concat(F.substring_index("name", "#", 1), F.lit(", A"), F.col("author_id"))
    links = paper_authors(spark, sf_dir).join(authors(spark, sf_dir), "author_id").withColumn("full", named)
    lists = ordered_list(links, "paper_id", F.struct("author_order", "author_id"), F.col("full"), "names")
    return lists.select("paper_id", author_line(F.col("names")).alias("line"))


@query("""WITH raw AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.-]*'), lambda x: trim(x, '._-')), lambda x: length(x) >= 2) AS marked,
list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_''-]+'), lambda x: trim(x, '''-')), lambda x: length(x) >= 2 AND x NOT IN ('a', 'an', 'and', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with')) AS named FROM conversations WHERE role = 'user')
SELECT conv_id, turn, array_to_string(list_filter(marked, lambda x, i: list_position(marked, x) = i)[1:8], ' ') AS marked, array_to_string(list_filter(named, lambda x, i: list_position(named, x) = i), ' ') AS named FROM raw""")  # fmt: skip
def query_terms(spark, sf_dir):
    """What users' turns, taken as searches, would mark and which words may name authors."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", F.array_join(highlight_terms(F.col("text")), " ").alias("marked"), F.array_join(author_terms(F.col("text")), " ").alias("named"))


@query("""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages) SELECT page_id, regexp_replace(regexp_replace(trim(regexp_replace(
replace(replace(replace(replace(replace(replace(replace(title, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') || ' (x) -y', '\\s+', ' ', 'g')), '\\s+([,;:.!?])', '\\1', 'g'), '\\)\\s+-\\s*', ')-', 'g') AS title FROM t
WHERE NOT regexp_matches(title, '[{}\\[\\]<>()]')""")  # fmt: skip
def clean_titles(spark, sf_dir):
    """Cleaned titles of pages, each wrapped in a publisher's markup that has to go; titles with brackets of their own are left to the tests."""
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    wrapped = F.concat(F.lit("{<b>"), title, F.lit("</b>} ( <i>x</i> ) - y"))
    return table(spark, sf_dir, "pages").where(~title.rlike(r"[{}\[\]<>()]")).select("page_id", clean_title(wrapped).alias("title"))


_OWNERS = "owners AS (SELECT paper_id, doi_id, confidence, seen FROM candidates WHERE approved)"


@query(with_ctes("candidates", more=_OWNERS + """,
other AS (SELECT c.paper_id, c.doi_id, c.confidence, o.confidence AS held, o.paper_id AS holder, o.seen AS held_seen FROM candidates c LEFT JOIN owners o ON o.doi_id = c.doi_id AND o.paper_id <> c.paper_id WHERE NOT c.approved
  QUALIFY row_number() OVER (PARTITION BY c.paper_id, c.doi_id ORDER BY o.confidence DESC NULLS LAST, o.paper_id) = 1)""") + """
SELECT paper_id, doi_id, holder, CASE WHEN holder IS NULL THEN 'free' WHEN (held_seen > 1 OR held >= 97) AND held >= 90 AND held >= confidence + 15 THEN 'reject' WHEN confidence >= held + 15 THEN 'candidate_better' ELSE 'ambiguous' END AS decision FROM other""")  # fmt: skip
def conflict_resolution(spark, sf_dir):
    """Each open candidate against the strongest other paper that has its identifier.

    The strongest two owners of an identifier tell the strongest other one for every paper, so owners are
    aggregated before they are joined and pairs of candidates and owners never arise.
    """
    c = candidates(spark, sf_dir)
    strength = F.struct("confidence", (-F.col("paper_id")).alias("back"), "seen")
    owners = c.where("approved").select("doi_id", "paper_id", strength.alias("owner"))
    first = owners.groupBy("doi_id").agg(F.max("owner").alias("first"))
    second = owners.join(first, "doi_id").where("owner.back <> first.back").groupBy("doi_id").agg(F.max("owner").alias("second"))
    best = first.join(second, "doi_id", "left")
    judged = c.where("NOT approved").select("paper_id", "doi_id", "confidence").join(best, "doi_id", "left")
    other = F.when(F.col("first.back") != -F.col("paper_id"), F.col("first")).otherwise(F.when(F.col("first.back").isNotNull(), F.col("second")))
    judged = judged.withColumn("o", other)
    held, mine = F.col("o.confidence"), F.col("confidence")
    trusted = (F.col("o.seen") > 1) | (held >= 97)
    verdict = F.when(held.isNull(), "free").when(trusted & (held >= 90) & (held >= mine + 15), "reject").when(mine >= held + 15, "candidate_better").otherwise("ambiguous")
    return judged.select("paper_id", "doi_id", (-F.col("o.back")).alias("holder"), verdict.alias("decision"))


@query(with_ctes("candidates", more="""wishes AS (SELECT paper_id, doi_id, confidence FROM candidates WHERE NOT approved AND confidence >= 90 QUALIFY row_number() OVER (PARTITION BY doi_id ORDER BY confidence DESC, paper_id) = 1),
taken AS (SELECT paper_id, doi_id FROM wishes QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY confidence DESC, doi_id DESC) = 1)""") + """
SELECT c.paper_id, c.doi_id, CASE WHEN t.paper_id = c.paper_id THEN 'approved' WHEN t.doi_id IS NOT NULL AND c.approved THEN 'rejected' WHEN o.doi_id IS NOT NULL THEN 'rejected' WHEN c.approved THEN 'approved' ELSE 'pending' END AS state
FROM candidates c LEFT JOIN taken t ON t.doi_id = c.doi_id LEFT JOIN taken o ON o.paper_id = c.paper_id""")  # fmt: skip
def reassign_identifiers(spark, sf_dir):
    """Sure candidates take their identifiers over: other owners lose them, the taker's other candidates are rejected.

    An identifier goes to its surest claimant (ties to the smaller paper), a paper takes one identifier (the surest,
    ties to the greater).
    """
    c = candidates(spark, sf_dir)
    wishes = c.where("NOT approved AND confidence >= 90").groupBy("doi_id").agg(F.max(F.struct("confidence", (-F.col("paper_id")).alias("back"))).alias("w"))
    taken = wishes.groupBy((-F.col("w.back")).alias("taker")).agg(F.max(F.struct(F.col("w.confidence").alias("confidence"), "doi_id"))["doi_id"].alias("doi_id"))
    by_doi = taken.select("doi_id", "taker")
    by_paper = taken.select(F.col("taker").alias("paper_id"), F.lit(True).alias("took"))
    state = (
        F.when(F.col("taker") == F.col("paper_id"), "approved").when(F.col("taker").isNotNull() & F.col("approved"), "rejected").when(F.col("took"), "rejected")
        .when(F.col("approved"), "approved").otherwise("pending")
    )
    return c.join(by_doi, "doi_id", "left").join(by_paper, "paper_id", "left").select("paper_id", "doi_id", state.alias("state"))


@query(with_ctes("activity", more="saved AS (SELECT DISTINCT user_id, event_type AS list_name, target FROM activity WHERE event_type IN ('view', 'purchase')), newest AS (SELECT target % 40 AS base, max(target) AS target FROM saved GROUP BY ALL)") + """
SELECT s.user_id, s.list_name, n.target, count(*) AS merged FROM saved s JOIN newest n ON n.base = s.target % 40 GROUP BY ALL""")  # fmt: skip
def rekey_saved_lists(spark, sf_dir):
    """Entries of users' lists under the newest revision (of one base) in place of older ones; one entry stays of each."""
    saved = activity(spark, sf_dir).where("event_type IN ('view', 'purchase')").select("user_id", F.col("event_type").alias("list_name"), "target").distinct()
    keyed = saved.withColumn("base", F.col("target") % 40).withColumnRenamed("target", "old")
    newest = keyed.groupBy("base").agg(F.max("old").alias("target"))
    return keyed.join(newest, "base").groupBy("user_id", "list_name", "target").agg(F.count("*").alias("merged"))


@query(with_ctes("keywords", "paper_keywords", more="""merged AS (SELECT keyword_id, phrase, min(keyword_id) OVER (PARTITION BY split_part(phrase, ' ', 2), score) AS kept FROM keywords),
links AS (SELECT kept, count(DISTINCT paper_id) AS papers FROM merged JOIN paper_keywords USING (keyword_id) GROUP BY kept)""") + """
SELECT k.kept AS keyword_id, any_value(d.phrase) AS phrase, coalesce(string_agg(DISTINCT k.phrase, '; ' ORDER BY k.phrase) FILTER (k.phrase <> d.phrase), '') AS aliases, coalesce(any_value(l.papers), 0) AS papers
FROM merged k JOIN keywords d ON d.keyword_id = k.kept LEFT JOIN links l ON l.kept = k.kept GROUP BY k.kept""")  # fmt: skip
def keyword_merge_aliases(spark, sf_dir):
    """Keywords merged into the first of their group: links move without doubles, the phrases that go become aliases."""
    k = keywords(spark, sf_dir).withColumn("family", F.split_part("phrase", F.lit(" "), F.lit(2)))
    first = k.groupBy("family", "score").agg(F.min(F.struct("keyword_id", "phrase")).alias("kept"))
    merged = k.join(first, ["family", "score"]).select("keyword_id", "phrase", "kept")
    links = paper_keywords(spark, sf_dir).join(merged, "keyword_id").select(F.col("kept.keyword_id").alias("keyword_id"), "paper_id").distinct()
    papers_of = links.groupBy("keyword_id").agg(F.count("*").alias("papers"))
    gone = F.collect_set(F.when(F.col("phrase") != F.col("kept.phrase"), F.col("phrase")))
    named = merged.groupBy("kept").agg(F.array_join(F.sort_array(gone), "; ").alias("aliases")).select("kept.*", "aliases")
    return named.join(papers_of, "keyword_id", "left").select("keyword_id", "phrase", "aliases", F.coalesce("papers", F.lit(0)).alias("papers"))


@query(with_ctes("keywords", "paper_keywords", more="""counted AS (SELECT phrase, count(DISTINCT paper_id) AS papers, bool_or(active) AS active FROM paper_keywords JOIN keywords USING (keyword_id) GROUP BY phrase),
kept AS (SELECT phrase, papers FROM counted WHERE len(string_split(phrase, ' ')) BETWEEN 2 AND 3 AND papers >= 5 AND contains(phrase, 'd') AND active)""") + """
SELECT phrase, papers, (SELECT count(*) FROM kept) AS total, (SELECT cast(greatest(1, (count(*) + 9) // 10) AS BIGINT) FROM kept) AS pages FROM kept ORDER BY papers DESC, phrase LIMIT 10""")  # fmt: skip
def phrase_triage_page(spark, sf_dir):
    """First page of the phrases by words, papers, substring and status, with the numbers of phrases and of pages."""
    held = paper_keywords(spark, sf_dir).join(keywords(spark, sf_dir), "keyword_id")
    counted = held.groupBy("phrase", "paper_id").agg(F.bool_or("active").alias("active")).groupBy("phrase").agg(F.count("*").alias("papers"), F.bool_or("active").alias("active"))
    words = F.size(F.split("phrase", " "))
    kept = counted.where(words.between(2, 3) & (F.col("papers") >= 5) & F.col("phrase").contains("d") & F.col("active")).select("phrase", "papers")
    total = kept.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 10)).cast("long"))
    return kept.orderBy(F.desc("papers"), "phrase").limit(10).join(F.broadcast(total))  # one row


@query(with_ctes("candidates") + "SELECT paper_id, doi_id, cast(cast(confidence / 100 AS DECIMAL(4, 3)) AS VARCHAR) AS confidence FROM candidates")
def confidence_texts(spark, sf_dir):
    """Confidences of candidates as state files hold them."""
    return candidates(spark, sf_dir).select("paper_id", "doi_id", confidence_text(F.col("confidence") / 100).alias("confidence"))
