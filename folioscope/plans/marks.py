"""Reviewers' marks on phrases, and landed revisions against rejected identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators.marks import Reviewed, replay_asked, replay_marks
from folioscope.operators.precedence import revised
from folioscope.plans.registry import Registry
from folioscope.plans.relations import candidates, keywords, paper_keywords, papers, table, with_ctes

registry = Registry()
query = registry.query


def _stored_review(spark, sf_dir) -> Reviewed:
    """Active keywords, and inactive ones as maths words, ignored phrases or aliases of the first active keyword of all."""
    term = F.concat(F.lit("term "), F.col("keyword_id").cast("string"))
    k = keywords(spark, sf_dir).select("keyword_id", term.alias("phrase"), "score", "active")
    first = k.where("active").agg(F.min("keyword_id").alias("first"))  # one row
    idle, kind = k.where("NOT active"), F.col("score") % 3
    aliases = idle.where(kind == 0).crossJoin(F.broadcast(first)).where("first IS NOT NULL").select(F.col("phrase").alias("alias"), F.concat(F.lit("term "), F.col("first").cast("string")).alias("phrase"))
    links = paper_keywords(spark, sf_dir).join(k.where("active"), "keyword_id").select("paper_id", "phrase")
    return Reviewed(k.where("active").select("phrase", "score"), aliases, idle.where(kind == 1).select("phrase"), idle.where(kind == 2).select("phrase"), links)


def _marks(spark, sf_dir):
    """One mark for each order line, in the order of their keys; of lines with the same key the one of the least part."""
    lines = table(spark, sf_dir, "lineitem")
    seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("seq")
    q = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 100
    status = F.when(q == 0, "math").when(q == 1, "ignore").when(q == 2, "unreviewed").when(q < 20, "alias").otherwise("useful")
    one = F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("of"), status.alias("status"))
    m = lines.select(seq, one.alias("m")).repartition("seq").groupBy("seq").agg(F.min("m").alias("m"))  # hardly any line repeats a key, so nothing is gained before the shuffle
    named = lambda c: F.concat(F.lit("term "), F.col(c).cast("string"))
    return m.select("seq", named("m.part").alias("phrase"), "m.status", F.when(F.col("m.status") == "alias", named("m.of")).alias("alias_of"))


_REPLAY = with_ctes("keywords", "paper_keywords", more="""k AS (SELECT keyword_id, 'term ' || keyword_id AS phrase, score, active FROM keywords),
m AS (SELECT l_orderkey * 8 + l_linenumber AS seq, min({part: l_partkey, of: l_suppkey, status: CASE (l_orderkey * 7 + l_linenumber * 13) % 100 WHEN 0 THEN 'math' WHEN 1 THEN 'ignore' WHEN 2 THEN 'unreviewed'
  ELSE CASE WHEN (l_orderkey * 7 + l_linenumber * 13) % 100 < 20 THEN 'alias' ELSE 'useful' END END}) AS m FROM lineitem GROUP BY 1),
marks AS (SELECT seq AS tick, 'term ' || m.part AS phrase, m.status AS status, CASE WHEN m.status = 'alias' THEN 'term ' || m.of END AS alias_of FROM m
  UNION ALL SELECT CASE WHEN active THEN -2 ELSE -1 END, phrase, CASE WHEN active THEN 'useful' WHEN score % 3 = 0 THEN 'alias' WHEN score % 3 = 1 THEN 'math' ELSE 'ignore' END,
    CASE WHEN NOT active AND score % 3 = 0 THEN 'term ' || (SELECT min(keyword_id) FROM keywords WHERE active) END FROM k),
asked AS (SELECT p.phrase, p.tick, r.phrase AS up, r.tick AS up_at FROM (SELECT * FROM marks WHERE status = 'alias' AND tick >= 0) p ASOF LEFT JOIN marks r ON p.alias_of = r.phrase AND p.tick > r.tick),
walk AS (SELECT phrase, tick, up, up_at, 0 AS n FROM asked UNION ALL SELECT w.phrase, w.tick, a.up, a.up_at, w.n + 1 FROM walk w JOIN asked a ON a.phrase = w.up AND a.tick = w.up_at),
ends AS (SELECT w.phrase, w.tick, CASE WHEN w.up IS NULL THEN w.n % 2 = 0 ELSE (r.status = 'useful') = (w.n % 2 = 1) END AS keyword FROM walk w LEFT JOIN marks r ON r.phrase = w.up AND r.tick = w.up_at
  WHERE w.up IS NULL OR NOT (r.status = 'alias' AND r.tick >= 0)),
judged AS (SELECT m.*, coalesce(e.keyword, m.status = 'useful') AS keyword FROM marks m LEFT JOIN ends e USING (phrase, tick)),
attached AS (SELECT phrase, tick, CASE WHEN keyword THEN phrase ELSE alias_of END AS holder FROM judged WHERE (keyword AND tick = -2) OR (NOT keyword AND status = 'alias' AND alias_of <> phrase)),
ended AS (SELECT a.*, e.tick AS end_at FROM attached a ASOF LEFT JOIN (SELECT phrase, tick FROM judged WHERE NOT keyword) e ON a.holder = e.phrase AND a.tick < e.tick),
way AS (SELECT phrase, tick, holder, end_at FROM ended UNION ALL SELECT w.phrase, w.tick, e.holder, e.end_at FROM way w JOIN ended e ON e.phrase = w.holder AND e.tick = w.end_at),
homes AS (SELECT phrase, tick, holder AS home FROM way WHERE end_at IS NULL),
last AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY tick DESC) = 1)
""").replace("WITH ", "WITH RECURSIVE ", 1)  # fmt: skip


@query(_REPLAY + """SELECT 'keyword' AS kind, l.phrase, l.phrase AS keyword, coalesce((SELECT k.score FROM k JOIN ended e ON e.phrase = k.phrase AND e.tick = -2 AND e.end_at IS NULL WHERE k.phrase = l.phrase), 5) AS score FROM last l WHERE keyword
UNION ALL SELECT 'alias', l.phrase, h.home, NULL FROM last l JOIN homes h USING (phrase, tick) WHERE NOT l.keyword AND l.status = 'alias'
UNION ALL SELECT status, phrase, NULL, NULL FROM last WHERE status IN ('math', 'ignore')""")  # fmt: skip
def candidate_marks_state(spark, sf_dir):
    """Where each phrase is after all marks: (kind, phrase, keyword, score)."""
    state, _ = replay_marks(_stored_review(spark, sf_dir), _marks(spark, sf_dir))
    none = lambda t: F.lit(None).cast(t)
    rows = lambda df, kind, phrase, keyword, score: df.select(F.lit(kind).alias("kind"), F.col(phrase).alias("phrase"), keyword.alias("keyword"), score.alias("score"))
    named = rows(state.keywords, "keyword", "phrase", F.col("phrase"), F.col("score")).unionByName(rows(state.aliases, "alias", "alias", F.col("phrase"), none("long")))
    return named.unionByName(rows(state.math, "math", "phrase", none("string"), none("long"))).unionByName(rows(state.ignored, "ignore", "phrase", none("string"), none("long")))


@query(_REPLAY + "SELECT DISTINCT pk.paper_id, h.home AS keyword FROM paper_keywords pk JOIN k USING (keyword_id) JOIN homes h ON h.phrase = k.phrase AND h.tick = -2 WHERE k.active")
def candidate_marks_links(spark, sf_dir):
    """Papers' links after all marks: those of keywords that became aliases have moved along, those of deleted ones are gone."""
    state, _ = replay_marks(_stored_review(spark, sf_dir), _marks(spark, sf_dir))
    return state.links.select("paper_id", F.col("phrase").alias("keyword"))


@query(_REPLAY + """SELECT status AS asked, CASE WHEN keyword THEN 'useful' WHEN status = 'alias' AND alias_of = phrase THEN 'unreviewed' ELSE status END AS answer, count(*) AS n FROM judged WHERE tick >= 0 GROUP BY ALL""")
def candidate_marks_answers(spark, sf_dir):
    """How often a mark of each kind came out as what: an alias of a phrase that is no keyword then makes a keyword."""
    _, answers = replay_asked(_stored_review(spark, sf_dir), _marks(spark, sf_dir))
    return answers.withColumnRenamed("status", "answer").groupBy("asked", "answer").agg(F.count("*").alias("n"))


@query(with_ctes("papers", "candidates", more="""c AS (SELECT paper_id, doi_id, approved, '10.1000/X' || doi_id AS doi FROM candidates),
stored AS (SELECT p.id, 1 + p.id % 3 AS version, CASE WHEN p.status <> 'O' THEN b.doi END AS doi, CASE WHEN p.status <> 'O' AND b.doi IS NOT NULL THEN CASE WHEN p.amount > 300000 THEN 'verified' ELSE 'auto' END END AS doi_status,
  CASE WHEN p.status = 'F' AND b.doi IS NOT NULL THEN 'published' END AS publication_status
  FROM papers p LEFT JOIN (SELECT paper_id, max_by(doi, doi_id) AS doi FROM c GROUP BY paper_id) b ON b.paper_id = p.id WHERE p.id % 5 <> 0),
landed AS (SELECT p.id, 1 + p.id % 4 AS version, CASE WHEN p.id % 6 <> 0 THEN b.doi END AS doi FROM papers p LEFT JOIN (SELECT paper_id, min_by(doi, doi_id) AS doi FROM c GROUP BY paper_id) b ON b.paper_id = p.id WHERE p.id % 7 <> 0),
j AS (SELECT coalesce(s.id, l.id) AS id, s.id IS NOT NULL AS has_s, l.id IS NOT NULL AS has_l, s.version AS sv, l.version AS lv, s.doi AS sd, l.doi AS ld, s.doi_status AS st, s.publication_status AS ps,
  EXISTS (SELECT 1 FROM c WHERE c.paper_id = l.id AND lower(c.doi) = lower(l.doi) AND NOT c.approved) AS rejected FROM stored s FULL JOIN landed l ON s.id = l.id),
o AS (SELECT *, CASE WHEN NOT has_l THEN 'untouched' WHEN NOT has_s THEN 'inserted' WHEN lv < sv THEN 'stale' WHEN ld IS NULL THEN 'no_doi' WHEN st = 'verified' AND sd IS NOT NULL AND lower(sd) <> lower(ld) THEN 'kept_verified'
  WHEN rejected AND lower(coalesce(sd, '')) = lower(ld) THEN 'rejected_removed' WHEN rejected THEN 'rejected_ignored' ELSE 'taken' END AS outcome FROM j)
""") + """SELECT id, CASE WHEN outcome IN ('untouched', 'stale') THEN sv ELSE lv END AS version, outcome,
  CASE WHEN outcome IN ('inserted', 'taken') THEN ld WHEN outcome = 'rejected_removed' THEN NULL ELSE sd END AS doi,
  CASE WHEN outcome IN ('inserted', 'taken') THEN CASE WHEN ld IS NOT NULL THEN 'arxiv' END WHEN outcome = 'rejected_removed' THEN NULL WHEN outcome = 'no_doi' AND sd IS NULL THEN NULL ELSE st END AS doi_status,
  CASE WHEN outcome IN ('inserted', 'taken') THEN CASE WHEN ld IS NOT NULL THEN 'published' END WHEN outcome = 'kept_verified' OR (outcome = 'no_doi' AND sd IS NOT NULL) THEN coalesce(ps, 'published') ELSE ps END AS publication_status FROM o""")  # fmt: skip
def revised_identifiers(spark, sf_dir):
    """All papers after a feed has landed: verified identifiers stay, those that were rejected for the same paper don't come back."""
    p, c = papers(spark, sf_dir), candidates(spark, sf_dir).withColumn("doi", F.concat(F.lit("10.1000/X"), F.col("doi_id").cast("string")))
    ends = c.groupBy("paper_id").agg(F.min_by("doi", "doi_id").alias("least"), F.max_by("doi", "doi_id").alias("most"))
    both = p.join(ends, F.col("id") == F.col("paper_id"), "left")
    had = F.when(F.col("status") != "O", F.col("most"))
    checked = F.when(had.isNotNull(), F.when(F.col("amount") > 300000, "verified").otherwise("auto"))
    published = F.when((F.col("status") == "F") & F.col("most").isNotNull(), "published")
    stored = both.where("id % 5 <> 0").select("id", (1 + F.col("id") % 3).alias("version"), had.alias("doi"), checked.alias("doi_status"), published.alias("publication_status"))
    landed = both.where("id % 7 <> 0").select("id", (1 + F.col("id") % 4).alias("version"), F.when(F.col("id") % 6 != 0, F.concat(F.lit("https://doi.org/"), "least")).alias("doi"))
    return revised(stored, landed, c.where("NOT approved").select(F.col("paper_id").alias("id"), "doi"))
