"""Ingest, merge and review as state transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators.state import cascade, difference, insert_ignore, newest_version, replace_children, upsert
from folioscope.plans.registry import Registry
from folioscope.plans.relations import AS_OF, candidates, keywords, paper_authors, paper_keywords, papers, users, with_ctes

registry = Registry()
query = registry.query


@query(with_ctes("papers", "candidates") + """SELECT id FROM papers WHERE published_date <= DATE '2001-08-01' - INTERVAL 30 DAY AND (status IS NULL OR status NOT IN ('P'))
AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.paper_id = id AND (c.approved OR c.confidence >= 90)) ORDER BY published_date DESC, id DESC LIMIT 500""")  # fmt: skip
def work_queue_anti(spark, sf_dir):
    """Papers still to be looked up: old enough, not skipped, without a pending or approved candidate."""
    busy = candidates(spark, sf_dir).where("approved OR confidence >= 90").select("paper_id")
    due = papers(spark, sf_dir).where((F.col("published_date") <= F.date_sub(F.lit(AS_OF).cast("date"), 30)) & (F.col("status").isNull() | ~F.col("status").isin("P")))
    return due.join(busy, F.col("id") == F.col("paper_id"), "left_anti").orderBy(F.desc("published_date"), F.desc("id")).limit(500).select("id")


@query(with_ctes("candidates") + """SELECT doi_id FROM candidates WHERE approved AND confidence = 100 UNION SELECT doi_id FROM candidates WHERE NOT approved AND confidence >= 50 GROUP BY doi_id HAVING count(DISTINCT paper_id) > 1""")
def conflicting_keys(spark, sf_dir):
    c = candidates(spark, sf_dir)
    shared = c.where("NOT approved AND confidence >= 50").groupBy("doi_id").agg(F.count("*").alias("n")).where("n > 1").select("doi_id")
    return c.where("approved AND confidence = 100").select("doi_id").union(shared).distinct()


@query(with_ctes("papers", "paper_keywords") + "SELECT pk.source, count(*) AS orphans FROM paper_keywords pk LEFT JOIN papers p ON p.id = pk.paper_id AND p.status <> 'O' WHERE p.id IS NULL GROUP BY pk.source")
def orphan_anti(spark, sf_dir):
    kept = papers(spark, sf_dir).where("status <> 'O'").select(F.col("id").alias("paper_id"))
    return paper_keywords(spark, sf_dir).join(kept, "paper_id", "left_anti").groupBy("source").agg(F.count("*").alias("orphans"))


@query(with_ctes("papers") + "SELECT user_id AS base_id, id AS keep_id, strftime(published_date, '%Y-%m-%d') AS published_date FROM papers QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY papers.published_date DESC, id DESC) = 1")
def identity_argmax(spark, sf_dir):
    """The row that stays of each base identity: the newest, then the greatest id."""
    p = papers(spark, sf_dir).select(F.col("user_id").alias("base_id"), F.col("id").alias("keep_id"), "published_date")
    return newest_version(p, "base_id", F.struct("published_date", "keep_id")).withColumn("published_date", F.date_format("published_date", "yyyy-MM-dd"))


_RANK = "CASE status WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END"


@query(with_ctes("papers") + f"""SELECT user_id AS base_id, strftime(min(published_date), '%Y-%m-%d') AS created, strftime(max(published_date), '%Y-%m-%d') AS updated, max(nullif(category, '5-LOW')) AS doi,
CASE max({_RANK}) WHEN 3 THEN 'F' WHEN 2 THEN 'O' ELSE 'P' END AS status, count(*) AS merged FROM papers GROUP BY user_id""")  # fmt: skip
def metadata_fold(spark, sf_dir):
    """Metadata of the rows that are merged into one; the highest status of the lattice F, O, P wins."""
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    return papers(spark, sf_dir).groupBy(F.col("user_id").alias("base_id")).agg(
        date(F.min("published_date")).alias("created"), date(F.max("published_date")).alias("updated"), F.max(F.nullif("category", F.lit("5-LOW"))).alias("doi"),
        F.max_by("status", F.expr(_RANK)).alias("status"), F.count("*").alias("merged"),
    )


@query(with_ctes("candidates") + """SELECT doi_id % 1000 AS key, max(confidence) AS confidence, CASE max(CASE WHEN approved THEN 3 WHEN confidence >= 50 THEN 2 ELSE 1 END) WHEN 3 THEN 'approved' WHEN 2 THEN 'pending' ELSE 'rejected' END AS status
FROM candidates GROUP BY 1""")  # fmt: skip
def status_lattice_upsert(spark, sf_dir):
    """Merged candidates keep the greatest confidence and the strongest status."""
    rank = F.when(F.col("approved"), 3).when(F.col("confidence") >= 50, 2).otherwise(1)
    named = F.element_at(F.array(F.lit("rejected"), F.lit("pending"), F.lit("approved")), F.max(rank))
    return candidates(spark, sf_dir).groupBy((F.col("doi_id") % 1000).alias("key")).agg(F.max("confidence").alias("confidence"), named.alias("status"))


@query(with_ctes("paper_keywords") + """, old AS (SELECT paper_id, source FROM paper_keywords WHERE keyword_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY keyword_id) = 1),
new AS (SELECT paper_id, 'X' AS source FROM paper_keywords GROUP BY paper_id)
SELECT paper_id, source FROM old UNION ALL SELECT paper_id, source FROM new WHERE paper_id NOT IN (SELECT paper_id FROM old)""")  # fmt: skip
def insert_ignore_rows(spark, sf_dir):
    links = paper_keywords(spark, sf_dir)
    old = links.where("keyword_id % 2 = 0").groupBy("paper_id").agg(F.min_by("source", "keyword_id").alias("source"))
    new = links.select("paper_id", F.lit("X").alias("source"))
    return insert_ignore(old, new, ["paper_id"], [F.col("source")])


@query(with_ctes("users") + """, old AS (SELECT user_id, user_name, segment FROM users WHERE user_id % 3 <> 0), new AS (SELECT user_id, 'renamed' AS user_name, 'NEW' AS segment FROM users WHERE user_id % 2 = 0)
SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN n.user_id IS NULL OR o.user_id IS NOT NULL AND false THEN o.user_name ELSE n.user_name END AS user_name, coalesce(o.segment, n.segment) AS segment
FROM old o FULL JOIN new n ON n.user_id = o.user_id""")  # fmt: skip
def upsert_on_duplicate(spark, sf_dir):
    u = users(spark, sf_dir).select("user_id", "user_name", "segment")
    new = u.where("user_id % 2 = 0").select("user_id", F.lit("renamed").alias("user_name"), F.lit("NEW").alias("segment"))
    return upsert(u.where("user_id % 3 <> 0"), new, ["user_id"], ["user_name"])


def _merged(stored, incoming):
    joined = stored.alias("s").join(incoming.alias("i"), "base_id", "full_outer")
    stale = F.col("i.version").isNull() | F.coalesce(F.col("i.version") < F.col("s.version"), F.lit(False))
    fixed = stale | F.coalesce(F.col("s.doi_status") == "verified", F.lit(False))
    pick = lambda c: F.when(stale, F.col(f"s.{c}")).otherwise(F.col(f"i.{c}")).alias(c)
    doi = F.when(fixed, F.col("s.doi")).otherwise(F.coalesce("i.doi", "s.doi")).alias("doi")
    return joined.select("base_id", pick("version"), pick("title"), doi, F.when(fixed | F.col("i.doi").isNull(), F.col("s.doi_status")).otherwise("auto").alias("doi_status"))


@query(with_ctes("papers") + """, stored AS (SELECT id // 4 AS base_id, id % 4 AS version, category AS title, CASE WHEN status = 'F' THEN 'doi-' || id END AS doi, CASE WHEN amount > 400000 THEN 'verified' WHEN status = 'F' THEN 'auto' END AS doi_status FROM papers WHERE id % 3 <> 0
  QUALIFY row_number() OVER (PARTITION BY id // 4 ORDER BY id DESC) = 1),
incoming AS (SELECT id // 4 AS base_id, id % 4 AS version, category AS title, CASE WHEN status = 'O' THEN 'doi-' || id END AS doi FROM papers WHERE id % 3 = 0
  QUALIFY row_number() OVER (PARTITION BY id // 4 ORDER BY id DESC) = 1)
SELECT coalesce(s.base_id, i.base_id) AS base_id,
  CASE WHEN s.base_id IS NULL OR i.version >= s.version THEN i.version ELSE s.version END AS version,
  CASE WHEN s.base_id IS NULL OR i.version >= s.version THEN i.title ELSE s.title END AS title,
  CASE WHEN i.base_id IS NULL OR i.version < s.version OR s.doi_status = 'verified' THEN s.doi ELSE coalesce(i.doi, s.doi) END AS doi,
  CASE WHEN i.base_id IS NULL OR i.version < s.version OR s.doi_status = 'verified' OR i.doi IS NULL THEN s.doi_status ELSE 'auto' END AS doi_status
FROM stored s FULL JOIN incoming i ON i.base_id = s.base_id""")  # fmt: skip
def versioned_upsert_whole(spark, sf_dir):
    """Every paper is stored or comes in, four to a base identity, so the state grows with the table."""
    p = papers(spark, sf_dir)
    base, version = F.floor(F.col("id") / 4).alias("base_id"), (F.col("id") % 4).alias("version")
    doi = lambda of: F.when(F.col("status") == of, F.concat(F.lit("doi-"), "id")).alias("doi")
    auto = F.when(F.col("amount") > 400000, "verified").when(F.col("status") == "F", "auto").alias("doi_status")
    stored = newest_version(p.where("id % 3 <> 0").select(base, version, F.col("category").alias("title"), doi("F"), auto), "base_id", F.col("version"))
    incoming = newest_version(p.where("id % 3 = 0").select(base, version, F.col("category").alias("title"), doi("O")), "base_id", F.col("version"))
    return _merged(stored, incoming)


@query(with_ctes("keywords", "paper_keywords") + """, target AS (SELECT phrase, min(keyword_id) AS keep_id FROM keywords GROUP BY phrase)
SELECT DISTINCT pk.paper_id, t.keep_id AS keyword_id FROM paper_keywords pk JOIN keywords k USING (keyword_id) JOIN target t USING (phrase)""")  # fmt: skip
def keyword_merge(spark, sf_dir):
    """Links of keywords with the same phrase move to the first of them; doubles go."""
    k = keywords(spark, sf_dir).select("keyword_id", "phrase")
    target = k.groupBy("phrase").agg(F.min("keyword_id").alias("keep_id"))
    moved = k.join(target, "phrase").select("keyword_id", "keep_id")
    return paper_keywords(spark, sf_dir).join(moved, "keyword_id").select("paper_id", F.col("keep_id").alias("keyword_id")).distinct()


@query(with_ctes("papers", "paper_authors", "paper_keywords") + """, gone AS (SELECT id FROM papers WHERE status = 'P')
SELECT 'authors' AS child, count(*) AS n FROM paper_authors WHERE paper_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'keywords', count(*) FROM paper_keywords WHERE paper_id NOT IN (SELECT id FROM gone)""")  # fmt: skip
def cascade_delete(spark, sf_dir):
    gone = papers(spark, sf_dir).where("status = 'P'").select("id")
    left = cascade(gone, {"authors": (paper_authors(spark, sf_dir), "paper_id"), "keywords": (paper_keywords(spark, sf_dir), "paper_id")})
    counts = [child.agg(F.lit(name).alias("child"), F.count("*").alias("n")) for name, child in left.items()]
    return counts[0].union(counts[1])


@query(with_ctes("papers") + """SELECT id, CASE WHEN id % 11 = 0 THEN 'missing' WHEN id % 7 = 0 THEN 'extra' ELSE 'changed' END AS change FROM papers
WHERE NOT (id % 11 = 0 AND id % 7 = 0) AND (id % 11 = 0 OR id % 7 = 0 OR (id % 5 = 0 AND status <> 'F'))""")  # fmt: skip
def state_diff_full_outer(spark, sf_dir):
    p = papers(spark, sf_dir).select("id", "status", "category")
    old = p.where("id % 11 <> 0")
    new = p.where("id % 7 <> 0").withColumn("status", F.when(F.col("id") % 5 == 0, "F").otherwise(F.col("status")))
    return difference(old, new, "id", ["status", "category"])


@query(with_ctes("papers") + """, h AS (SELECT user_id, status, md5(id || ':' || status) AS m FROM papers)
SELECT count(*) AS n, cast(count_if(status = 'F') AS BIGINT) AS verified, count(DISTINCT user_id) AS owners, (SELECT count(*) FROM (SELECT user_id FROM papers GROUP BY user_id HAVING count(*) > 1)) AS shared,
concat_ws('-', cast(sum(cast('0x' || substr(m, 1, 15) AS BIGINT)) AS VARCHAR), cast(sum(cast('0x' || substr(m, 16, 15) AS BIGINT)) AS VARCHAR)) AS digest FROM h""")  # fmt: skip
def state_summary_whole(spark, sf_dir):
    """Counts and a digest of all papers; the digest is two sums of 60 bits of each row's hash, so no order and no row list is needed."""
    p = papers(spark, sf_dir)
    shared = p.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("shared"))
    hashed = p.withColumn("m", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.coalesce("status", F.lit("")))))
    total = lambda at: F.sum(F.conv(F.substring("m", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    own = hashed.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "F").alias("verified"), F.concat_ws("-", total(1), total(16)).alias("digest"))
    owners = p.groupBy("user_id").agg(F.lit(1)).agg(F.count("user_id").alias("owners"))
    return own.join(F.broadcast(owners)).join(F.broadcast(shared))  # one row each


@query(with_ctes("paper_keywords") + """, fresh AS (SELECT paper_id, keyword_id, 'A' AS source FROM paper_keywords WHERE (paper_id + keyword_id) % 3 = 0 AND paper_id % 2 = 0)
, kept AS (SELECT * FROM paper_keywords WHERE NOT (source = 'A' AND paper_id % 2 = 0))
SELECT source, count(*) AS n FROM (SELECT * FROM kept UNION ALL SELECT f.* FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.paper_id = f.paper_id AND k.keyword_id = f.keyword_id)) GROUP BY source""")  # fmt: skip
def retag_preserving_manual(spark, sf_dir):
    """Retagging replaces automatic links of the given papers only; manual and system links win over new ones."""
    links = paper_keywords(spark, sf_dir)
    kept = links.where("NOT (source = 'A' AND paper_id % 2 = 0)")
    fresh = links.where("(paper_id + keyword_id) % 3 = 0 AND paper_id % 2 = 0").withColumn("source", F.lit("A"))
    return insert_ignore(kept, fresh, ["paper_id", "keyword_id"], [F.col("source")]).groupBy("source").agg(F.count("*").alias("n"))


@query(with_ctes("papers", "paper_authors") + """SELECT paper_id, author_id, author_order FROM paper_authors WHERE paper_id % 10 <> 0 UNION ALL SELECT paper_id, max(author_id), 1 FROM paper_authors WHERE paper_id % 10 = 0 GROUP BY paper_id""")
def replace_children_rows(spark, sf_dir):
    old = paper_authors(spark, sf_dir)
    parents = papers(spark, sf_dir).where("id % 10 = 0").select(F.col("id").alias("paper_id"))
    new = old.groupBy("paper_id").agg(F.max("author_id").alias("author_id"), F.lit(1).alias("author_order"))
    return replace_children(old, new, "paper_id", parents)


@query(with_ctes("keywords", "paper_keywords") + """, used AS (SELECT phrase, count(*) AS n, bool_or(active) AS useful, bool_or(score = 1) AS alias, bool_or(score = 2) AS math, bool_or(score = 3) AS ignored FROM paper_keywords JOIN keywords USING (keyword_id) GROUP BY phrase)
SELECT phrase, n, CASE WHEN useful AND n % 2 = 0 THEN 'useful' WHEN alias THEN 'alias' WHEN math THEN 'math' WHEN ignored THEN 'ignore' ELSE 'unreviewed' END AS status FROM used""")  # fmt: skip
def candidate_status_precedence(spark, sf_dir):
    """A phrase's review state: useful before alias before math before ignored before unreviewed."""
    joined = paper_keywords(spark, sf_dir).join(keywords(spark, sf_dir), "keyword_id")
    flag = lambda n: F.bool_or(F.col("score") == n)
    used = joined.groupBy("phrase").agg(F.count("*").alias("n"), F.bool_or("active").alias("useful"), flag(1).alias("alias"), flag(2).alias("math"), flag(3).alias("ignored"))
    status = F.when(F.col("useful") & (F.col("n") % 2 == 0), "useful").when(F.col("alias"), "alias").when(F.col("math"), "math").when(F.col("ignored"), "ignore").otherwise("unreviewed")
    return used.select("phrase", "n", status.alias("status"))


registry.also("state_summary", "state_summary_whole")
registry.also("versioned_upsert", "versioned_upsert_whole")
