"""Identifiers, record linkage and triage of proposed publications."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.identifiers import base_and_version, doi_in, doi_key, is_preprint_doi, preprint_id, publication
from folioscope.operators.pairing import score_pairs
from folioscope.operators.triage import confidence, decision, reference_match
from folioscope.plans.registry import Registry
from folioscope.plans.relations import candidates, papers, table, with_ctes

registry = Registry()
query = registry.query

_INPUT = """CASE page_id % 6 WHEN 0 THEN 'arXiv:24' || lpad(cast(page_id % 100 AS VARCHAR), 2, '0') || '.' || lpad(cast(page_id AS VARCHAR), 5, '0') || 'v' || (1 + page_id % 3)
  WHEN 1 THEN 'https://arxiv.org/pdf/2401.' || lpad(cast(page_id AS VARCHAR), 5, '0') || 'v2.pdf' WHEN 2 THEN 'arxiv.org/abs/math/' || lpad(cast(page_id AS VARCHAR), 7, '0')
  WHEN 3 THEN url WHEN 4 THEN 'see (2401.' || lpad(cast(page_id AS VARCHAR), 5, '0') || ') there' ELSE '<https://export.arxiv.org/format/2402.' || lpad(cast(page_id AS VARCHAR), 5, '0') || '>.' END"""


@query(f"WITH i AS (SELECT page_id, {_INPUT} AS raw FROM pages), " + """x AS (SELECT page_id, CASE WHEN raw LIKE 'http%' AND NOT regexp_matches(raw, '^https?://([a-z]+\\.)?arxiv\\.org/') THEN '' ELSE regexp_extract(raw, '(^|[^A-Za-z0-9.-])((\\d{4}\\.\\d{4,5}|math/\\d{7})(v\\d+)?)', 2) END AS found FROM i)
SELECT page_id, nullif(found, '') AS arxiv_id, nullif(regexp_replace(found, 'v\\d+$', ''), '') AS base, CASE WHEN found = '' THEN NULL ELSE coalesce(try_cast(regexp_extract(found, 'v(\\d+)$', 1) AS INTEGER), 1) END AS version FROM x""")  # fmt: skip
def arxiv_id_extract(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").select("page_id", F.expr(_INPUT.replace("VARCHAR", "STRING")).alias("raw"))
    found = raw.select("page_id", preprint_id(F.col("raw")).alias("arxiv_id"), base_and_version(F.col("raw")).alias("v"))
    return found.select("page_id", "arxiv_id", "v.base", "v.version")


_DOI = "CASE page_id % 4 WHEN 0 THEN 'HTTPS://DOI.ORG/10.1000/Ex.' || page_id || '.' WHEN 1 THEN ' doi:10.48550/arXiv.2211.' || page_id || '; ' WHEN 2 THEN 'see 10.1234/AbC-' || page_id || ', p. 3' ELSE url END"


@query(f"WITH i AS (SELECT page_id, {_DOI} AS raw FROM pages), " + """k AS (SELECT page_id, raw, rtrim(regexp_replace(lower(trim(raw)), '^(https?://(dx\\.)?doi\\.org/|doi:)', ''), '.,; ') AS doi_key FROM i)
SELECT page_id, doi_key, nullif(rtrim(regexp_extract(trim(raw), '(10\\.[0-9]{4,9}/[^\\s<>"{}|\\\\^`\\[\\]]+)', 1), '.,;)'), '') AS doi, starts_with(doi_key, '10.48550/arxiv.') AS preprint FROM k""")  # fmt: skip
def doi_normalize_both(spark, sf_dir):
    """One form for display, which keeps case, and one for comparison, which does not check the shape."""
    raw = table(spark, sf_dir, "pages").select("page_id", F.expr(_DOI).alias("raw"))
    return raw.select("page_id", doi_key(F.col("raw")).alias("doi_key"), doi_in(F.col("raw")).alias("doi"), is_preprint_doi(F.col("raw")).alias("preprint"))


_PUB = "CASE page_id % 4 WHEN 0 THEN 'https://cs.uwaterloo.ca/journals/JIS/VOL' || page_id || '/x.html' WHEN 1 THEN 'https://doi.org/10.1002/jgt.' || (20000 + page_id) WHEN 2 THEN 'www.emis.de/journals/SLC/s' || page_id ELSE url END"


@query(f"WITH i AS (SELECT page_id, {_PUB} AS raw FROM pages)" + """ SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'doi' WHEN 3 THEN 'publication_url' ELSE 'known_no_doi' END AS kind, CASE page_id % 4 WHEN 0 THEN 'jis' WHEN 2 THEN 'slc' END AS venue,
CASE page_id % 4 WHEN 1 THEN NULL WHEN 2 THEN 'https://' || raw ELSE raw END AS url, CASE page_id % 4 WHEN 1 THEN 'verified' WHEN 3 THEN NULL ELSE 'skipped' END AS doi_status FROM i""")  # fmt: skip
def url_venue_parse(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").select("page_id", publication(F.expr(_PUB)).alias("p"))
    return raw.select("page_id", "p.kind", "p.venue", "p.url", "p.doi_status")


_TITLES = "t AS (SELECT page_id, list_distinct(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)', 1)), '[a-z]+')) AS toks FROM pages)"
_RARE = "tok AS (SELECT page_id, unnest(toks) AS tok FROM t), rare AS (SELECT tok FROM tok GROUP BY tok HAVING count(*) BETWEEN 2 AND 12)"


@query(f"WITH {_TITLES}, {_RARE}" + """, pairs AS (SELECT DISTINCT a.page_id AS a, b.page_id AS b FROM tok a JOIN rare USING (tok) JOIN tok b ON a.tok = b.tok AND a.page_id < b.page_id)
SELECT a, b, round(len(list_intersect(x.toks, y.toks)) / len(list_distinct(x.toks || y.toks)), 6) AS jaccard FROM pairs JOIN t x ON x.page_id = a JOIN t y ON y.page_id = b WHERE len(list_intersect(x.toks, y.toks)) >= 2""")  # fmt: skip
def title_jaccard_pairs(spark, sf_dir):
    """Word overlap of title pairs that share a rare word: blocked, never all pairs."""
    titles, pairs = _blocked(spark, sf_dir)
    side = lambda c: titles.select(F.col("page_id").alias(c), F.col("toks").alias(f"t_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("t_a", "t_b"))).where("both >= 2")
    return joined.select("a", "b", F.round(F.col("both") / F.size(F.array_union("t_a", "t_b")), 6).alias("jaccard"))


def _blocked(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    toks = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("[a-z]+"), F.lit(0)))
    titles = table(spark, sf_dir, "pages").select("page_id", title.alias("title"), toks.alias("toks"))
    tok = titles.select("page_id", F.explode("toks").alias("tok"))
    rare = tok.groupBy("tok").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 12").select("tok")
    kept = tok.join(rare, "tok")
    pairs = kept.select("tok", F.col("page_id").alias("a")).join(kept.select("tok", F.col("page_id").alias("b")), "tok").where("a < b").select("a", "b").distinct()
    return titles, pairs


_SETS = "sets AS (SELECT list_sort(toks) AS toks, min(page_id) AS a FROM t WHERE len(toks) > 0 GROUP BY 1)"


@query(f"WITH {_TITLES}, {_SETS}" + """ SELECT a, page_id AS b, 1.0::DOUBLE AS jaccard FROM t JOIN sets s ON s.toks = list_sort(t.toks) WHERE page_id > a
UNION ALL SELECT x.a, y.a, round(len(list_intersect(x.toks, y.toks)) / len(list_distinct(x.toks || y.toks)), 6) FROM sets x JOIN sets y ON x.a < y.a WHERE 100 * len(list_intersect(x.toks, y.toks)) >= 80 * len(list_distinct(x.toks || y.toks))""")  # fmt: skip
def title_similar_pairs(spark, sf_dir):
    """All titles with a word overlap of 0.8 or more: each page with the first page of its word set, and those first pages with each other.

    Words of any frequency count; a title without a word is in no pair. title_jaccard_pairs shows looser pairs, but of words on 2 to 12 pages only.
    """
    titles = _titles(spark, sf_dir).where(F.size("toks") > 0)
    sets = _word_sets(titles)
    members = titles.join(sets, "toks").where("page_id > first").select(F.col("first").alias("a"), F.col("page_id").alias("b"), F.lit(1.0).alias("jaccard"))
    return members.union(_similar_sets(sets))


def _titles(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    toks = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("[a-z]+"), F.lit(0))))
    return table(spark, sf_dir, "pages").select("page_id", "url", title.alias("title"), toks.alias("toks"))


def _word_sets(titles):
    return titles.groupBy("toks").agg(F.min("page_id").alias("first"))


def _similar_sets(sets, percent=80):
    """(a, b, jaccard) of different word sets (toks, first): similar sets share one of their rarest words, as many as they may differ in and one more."""
    tok = sets.select("first", F.explode("toks").alias("tok"))
    rarest = tok.join(tok.groupBy("tok").agg(F.count("*").alias("n")), "tok").groupBy("first").agg(F.sort_array(F.collect_list(F.struct("n", "tok"))).alias("ordered"))
    size = F.size("ordered")
    prefix = rarest.select("first", size.alias("size"), F.explode(F.slice("ordered", 1, size - F.ceil(size * percent / 100).cast("int") + 1)).alias("o")).select("first", "size", "o.tok")
    side = lambda c: prefix.select("tok", F.col("first").alias(c), F.col("size").alias(f"n_{c}"))
    near = side("a").join(side("b"), "tok").where(f"a < b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b").distinct()
    whole = lambda c: sets.select(F.col("first").alias(c), F.col("toks").alias(f"t_{c}"))
    both, either = F.size(F.array_intersect("t_a", "t_b")), F.size(F.array_union("t_a", "t_b"))
    return near.join(whole("a"), "a").join(whole("b"), "b").where(100 * both >= percent * either).select("a", "b", F.round(both / either, 6).alias("jaccard"))


def _rare_sets(sets):
    """(a, b) of word sets that share a word of 2 to 12 sets, however little else."""
    tok = sets.select("first", F.explode("toks").alias("tok"))
    kept = tok.join(tok.groupBy("tok").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 12").select("tok"), "tok")
    return kept.withColumnRenamed("first", "a").join(kept.withColumnRenamed("first", "b"), "tok").where("a < b").select("a", "b")


@query()
def match_score(spark, sf_dir):
    """Record scores of title pairs, with the hosts' parts as names; tested against plain Python.

    Pages with one title and the same names are one record, which the first of them stands for: its row with every other page tells which. Records
    are paired whose word sets are equal, overlap by 0.8 or more, or share a rare word; no word is too frequent for the first two.
    """
    titles = _titles(spark, sf_dir).where(F.size("toks") > 0)
    names = F.transform(F.split(F.regexp_extract("url", "://([^/]+)", 1), r"\."), lambda h: F.concat(F.lit("A "), h))
    pages = titles.select("page_id", "toks", "title", names.alias("names"))
    sets = _word_sets(titles)
    records = pages.groupBy("toks", "title", "names").agg(F.min("page_id").alias("record")).join(sets, "toks")
    side = lambda c, by: records.select(F.col("first").alias(by), F.col("record").alias(c), F.col("title").alias(f"t_{c}"), F.col("names").alias(f"n_{c}"))
    linked = _similar_sets(sets).select("a", "b").union(_rare_sets(sets)).distinct().select(F.col("a").alias("s_x"), F.col("b").alias("s_y"))
    between = linked.join(side("x", "s_x"), "s_x").join(side("y", "s_y"), "s_y").drop("s_x", "s_y")
    within = side("x", "s").join(side("y", "s"), "s").where("x < y").drop("s")
    copies = pages.join(records.select("title", "names", "record"), ["title", "names"]).where("page_id > record")
    copies = copies.select(F.col("record").alias("x"), F.col("title").alias("t_x"), F.col("names").alias("n_x"), F.col("page_id").alias("y"), F.col("title").alias("t_y"), F.col("names").alias("n_y"))
    both = between.unionByName(within).unionByName(copies)
    turn = lambda c, u, v: F.when(F.col("x") < F.col("y"), F.col(f"{c}{u}")).otherwise(F.col(f"{c}{v}"))
    ordered = both.select(turn("", "x", "y").alias("a"), turn("", "y", "x").alias("b"), *(turn(c, u, v).alias(n) for c, u, v, n in [("t_", "x", "y", "title_a"), ("n_", "x", "y", "names_a"), ("t_", "y", "x", "title_b"), ("n_", "y", "x", "names_b")]))
    scored = score_pairs(ordered)
    return scored.select("a", "b", *(F.bround(c, 3).alias(c) for c in ("title", "coverage", "score")))


_SCORED = """s AS (SELECT paper_id, doi_id, '10.1/' || doi_id AS queued, CASE WHEN doi_id % 5 = 0 THEN NULL WHEN doi_id % 5 = 1 THEN '10.48550/arxiv.' || doi_id WHEN doi_id % 5 = 2 THEN '10.1/' || (doi_id + 1) ELSE '10.1/' || doi_id END AS linked,
  confidence >= 90 AS q_conflict, confidence <= 10 AS l_conflict, (doi_id * 7 % 100) / 100.0 AS stored, (doi_id * 13 % 100) / 100.0 AS l_score, (paper_id * 3 % 101) / 100.0 AS title, (paper_id * 11 % 101) / 100.0 AS coverage, approved AS exact FROM candidates)"""


@query(with_ctes("candidates", more=_SCORED) + """SELECT decision, count(*) AS n FROM (SELECT CASE
  WHEN linked IS NULL OR starts_with(linked, '10.48550/arxiv.') THEN CASE WHEN NOT q_conflict AND (exact OR (title >= 0.98 AND coverage >= 0.95 AND stored >= 0.95)) AND stored >= 0.85 THEN 'metadata_exact'
    WHEN NOT q_conflict AND stored >= 0.84 AND title >= 0.78 AND coverage >= 0.95 THEN 'review_high_evidence' ELSE 'unresolved' END
  WHEN linked = queued THEN CASE WHEN q_conflict THEN 'review_exact_conflict' WHEN greatest(stored, l_score) >= 0.85 THEN 'approve_confirmed' ELSE 'review_exact_weak_metadata' END
  WHEN l_score < 0.85 THEN 'review_disagreement' WHEN l_conflict THEN 'review_replacement_conflict' ELSE 'replacement_confirmed' END AS decision FROM s) GROUP BY decision""")  # fmt: skip
def triage_decision(spark, sf_dir):
    c = candidates(spark, sf_dir)
    part = lambda of, by, size: (F.col(of) * by % size) / 100.0
    doi = lambda k: F.concat(F.lit("10.1/"), k)
    linked = F.when(F.col("doi_id") % 5 == 0, None).when(F.col("doi_id") % 5 == 1, F.concat(F.lit("10.48550/arxiv."), "doi_id")).when(F.col("doi_id") % 5 == 2, doi(F.col("doi_id") + 1)).otherwise(doi(F.col("doi_id")))
    verdict = decision(doi(F.col("doi_id")), linked, F.col("confidence") >= 90, F.col("confidence") <= 10, part("doi_id", 7, 100), part("doi_id", 13, 100), part("paper_id", 3, 101), part("paper_id", 11, 101), F.col("approved"))
    return c.groupBy(verdict.alias("decision")).agg(F.count("*").alias("n"))


@query(with_ctes("candidates") + """SELECT doi_id % 2 = 0 AS has_locator, count_if((seen = 1) AND (((paper_id % 3 = 0) AND ((doi_id % 7 < 3) OR (confidence % 100) / 100.0 >= 0.40)) OR (NOT (doi_id % 2 = 0) AND (doi_id % 7 < 3) AND (confidence % 100) / 100.0 >= 0.80)))::BIGINT AS matches, count(*) AS n
FROM candidates GROUP BY 1""")  # fmt: skip
def journal_evidence(spark, sf_dir):
    c = candidates(spark, sf_dir)
    fits = reference_match(F.col("seen") == 1, F.col("doi_id") % 7 < 3, F.col("paper_id") % 3 == 0, F.col("doi_id") % 2 == 0, (F.col("confidence") % 100) / 100.0)
    return c.groupBy((F.col("doi_id") % 2 == 0).alias("has_locator")).agg(F.count_if(fits).alias("matches"), F.count("*").alias("n"))


@query(with_ctes("papers", "candidates") + """SELECT paper_id, doi_id, confidence FROM candidates JOIN papers ON id = paper_id WHERE confidence >= 60
QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY confidence DESC, doi_id) = 1""")  # fmt: skip
def best_candidate(spark, sf_dir):
    """The best candidate of each paper, the first of equal ones, if it is good enough."""
    c = candidates(spark, sf_dir).where("confidence >= 60").join(papers(spark, sf_dir).select(F.col("id").alias("paper_id")), "paper_id")
    best = F.max_by(F.struct("doi_id", "confidence"), F.struct("confidence", -F.col("doi_id")))
    return c.groupBy("paper_id").agg(best.alias("b")).select("paper_id", "b.*")


@query("""WITH x AS (SELECT page_id, (page_id % 100) / 100.0 AS score, 1990 + page_id % 30 AS y, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 1991 + page_id % 29 END AS r, page_id % 2 = 0 AS j FROM pages)
SELECT page_id, round_even(0.8 * score + 0.1 * CASE WHEN r IS NULL THEN 0.3 WHEN abs(y - r) <= 1 THEN 1.0 WHEN abs(y - r) <= 2 THEN 0.5 ELSE 0.0 END + 0.1 * CASE WHEN j THEN 1.0 ELSE 0.5 END, 3)::DOUBLE AS confidence FROM x""")  # fmt: skip
def registry_confidence(spark, sf_dir):
    p = F.col("page_id")
    score = confidence((p % 100) / 100.0, 1990 + p % 30, F.when(p % 5 == 0, None).otherwise(1991 + p % 29), p % 2 == 0)
    return table(spark, sf_dir, "pages").select("page_id", score.alias("confidence"))
