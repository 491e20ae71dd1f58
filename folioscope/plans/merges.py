"""Merging states and identities: signed plans between two recorded states, and revisions of one work made one row."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.operators import identity, merge_plan
from folioscope.operators.snapshots import Snapshots
from folioscope.operators.stored import bucketed, remove, shared_folder
from folioscope.plans.registry import Registry
from folioscope.plans.relations import table

registry = Registry()
query = registry.query

KEYS, FIELDS = ("paper_id",), ("status", "lines")


def _states(spark, sf_dir):
    """(source, target): the states of papers as their lines tell them, and as their orders tell them with the lines of open ones."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id"))
    told = lines.agg(F.min("l_linestatus").alias("low"), F.max("l_linestatus").alias("high"), F.count("*").alias("lines"))
    source = told.select("paper_id", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("P").alias("status"), "lines")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderstatus").alias("status"))
    target = orders.join(source.select("paper_id", "lines"), "paper_id", "left").withColumn("lines", F.when(F.col("status") == "O", F.col("lines")))
    return source, target.where("paper_id % 7 <> 0")  # the target lacks some papers


_STATES = """WITH told AS (SELECT l_orderkey AS paper_id, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS status, count(*) AS lines FROM lineitem GROUP BY ALL),
target AS (SELECT o_orderkey AS paper_id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'O' THEN lines END AS lines FROM orders LEFT JOIN told ON paper_id = o_orderkey WHERE o_orderkey % 7 <> 0)
"""
_ROW = "'{\"status\":\"' || {0}.status || '\",\"lines\":' || coalesce(cast({0}.lines AS VARCHAR), 'null') || '}'"
_json = lambda t: _ROW.replace("{0}", t)


@query(_STATES + f"""SELECT '{{"paper_id":' || s.paper_id || '}}' AS key, CASE WHEN t.paper_id IS NULL THEN 'insert' ELSE 'update' END AS action, CASE WHEN t.paper_id IS NOT NULL THEN {_json("t")} END AS expected, {_json("s")} AS desired
FROM told s LEFT JOIN target t ON t.paper_id = s.paper_id WHERE t.paper_id IS NULL OR t.status <> s.status OR t.lines IS DISTINCT FROM s.lines""")  # fmt: skip
def merge_plan_actions(spark, sf_dir):
    """The inserts and compare-and-set updates that bring one recorded state to the other."""
    source, target = _states(spark, sf_dir)
    return merge_plan.make_plan(source, target, KEYS, FIELDS).actions


@query(_STATES + "SELECT paper_id, coalesce(s.status, t.status) AS status, CASE WHEN s.paper_id IS NULL THEN t.lines ELSE s.lines END AS lines FROM told s FULL JOIN target t USING (paper_id)")
def merge_plan_applied(spark, sf_dir):
    """The target after the plan was verified and applied; its own rows stay."""
    source, target = _states(spark, sf_dir)
    return merge_plan.apply(merge_plan.make_plan(source, target, KEYS, FIELDS), target, source)


@query(_STATES + "SELECT paper_id, status, lines FROM target")
def merge_plan_undone(spark, sf_dir):
    """The target again, after the plan and its inverse."""
    source, target = _states(spark, sf_dir)
    plan = merge_plan.make_plan(source, target, KEYS, FIELDS)
    return merge_plan.apply(merge_plan.inverse(plan), merge_plan.apply(plan, target, source))


@query(_STATES + """SELECT paper_id, CASE WHEN s.paper_id IS NULL THEN t.status ELSE s.status END AS status, CASE WHEN s.paper_id IS NULL THEN t.lines ELSE s.lines END AS lines
FROM (SELECT * FROM told WHERE status <> 'P') s FULL JOIN target t USING (paper_id)""")  # fmt: skip
def one_way_merge(spark, sf_dir):
    """Only settled rows of the source update or insert; all others stay."""
    source, target = _states(spark, sf_dir)
    return merge_plan.apply(merge_plan.make_plan(source, target, KEYS, FIELDS, only=F.col("status") != "P"), target, source)


def _tables(spark, sf_dir, lines=None):
    """An archive in which revisions of one work are rows of their own: orders of one customer and priority. lines: lineitem, if it was dealt by orders."""
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem") if lines is None else lines
    day, cents = F.col("o_orderdate").cast("date"), F.col("o_totalprice")
    base = F.concat(F.col("o_custkey").cast("string"), F.lit("."), F.substring("o_orderpriority", 1, 1))
    known = lambda least, value: F.when(cents > least, value)
    arxiv_id = F.concat(base, F.lit("v"), F.col("o_orderkey").cast("string")).alias("arxiv_id")
    papers = o.select(
        F.col("o_orderkey").alias("id"), base.alias("base_id"), arxiv_id, day.alias("published_date"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(day, 400)).alias("updated_date"), day.alias("created_at"), F.date_add(day, 7).alias("updated_at"),
        known(300000, F.concat(F.lit("10."), F.col("o_orderkey").cast("string"))).alias("doi"),
        F.when(cents > 450000, "verified").when(cents > 400000, "arxiv").when(cents > 300000, "auto").when(cents < 50000, "skipped").alias("doi_status"),
        known(250000, cents).alias("doi_confidence"), known(200000, day).alias("doi_checked_at"), F.when(cents < 100000, F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))).otherwise("").alias("publication_url"),
        F.when(cents < 90000, F.col("o_orderstatus")).alias("publication_venue_key"), F.when(cents < 30000, "known_no_doi").when(cents < 60000, "arxiv_only").when(cents < 90000, "published").alias("publication_status"),
        F.when(cents < 20000, "note").alias("editor_note"),
    )
    keywords = lines.groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("keyword_id")).agg(F.min("l_returnflag").alias("flag"))
    number = F.col("l_partkey") * 10 + F.col("l_suppkey") % 10
    shipped = F.col("l_shipdate").cast("date")
    candidates = lines.groupBy(F.col("l_orderkey").alias("paper_id"), (F.col("l_partkey") % 50).alias("n")).agg(F.min(number * 1_000_000_000 + F.col("l_orderkey")).alias("candidate_id"), F.max("l_discount").alias("confidence"), F.min("l_returnflag").alias("flag"), F.max(F.when(F.col("l_linestatus") == "F", shipped)).alias("reviewed_at"))
    return {
        "papers": papers,
        "tags": lines.groupBy(F.col("l_orderkey").alias("paper_id"), (F.col("l_suppkey") % 5).alias("tag_id")).agg(F.min(shipped).alias("created_at")),
        "keywords": keywords.select("paper_id", "keyword_id", F.when(F.col("flag") == "A", "auto").when(F.col("flag") == "N", "manual").otherwise("system").alias("source")),
        "candidates": candidates.select("candidate_id", "paper_id", F.concat(F.lit("10.9/"), F.col("n").cast("string")).alias("doi"), "confidence", F.when(F.col("flag") == "A", "approved").when(F.col("flag") == "N", "pending").otherwise("rejected").alias("status"), "reviewed_at"),
        "lists": o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("list_name"), arxiv_id, day.alias("added_at")),
        "authors": lines.groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")).agg(F.min("l_linenumber").alias("author_order")),
        "categories": o.select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("category")),
    }


_ARCHIVE = """WITH papers AS (SELECT o_orderkey AS id, o_custkey || '.' || substr(o_orderpriority, 1, 1) AS base_id, o_custkey || '.' || substr(o_orderpriority, 1, 1) || 'v' || o_orderkey AS arxiv_id, cast(o_orderdate AS DATE) AS published_date,
  CASE WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS DATE) + 400 END AS updated_date, cast(o_orderdate AS DATE) AS created_at, cast(o_orderdate AS DATE) + 7 AS updated_at, CASE WHEN o_totalprice > 300000 THEN '10.' || o_orderkey END AS doi,
  CASE WHEN o_totalprice > 450000 THEN 'verified' WHEN o_totalprice > 400000 THEN 'arxiv' WHEN o_totalprice > 300000 THEN 'auto' WHEN o_totalprice < 50000 THEN 'skipped' END AS doi_status,
  CASE WHEN o_totalprice > 250000 THEN o_totalprice END AS doi_confidence, CASE WHEN o_totalprice > 200000 THEN cast(o_orderdate AS DATE) END AS doi_checked_at, CASE WHEN o_totalprice < 100000 THEN 'u' || o_orderkey ELSE '' END AS publication_url,
  CASE WHEN o_totalprice < 90000 THEN o_orderstatus END AS publication_venue_key, CASE WHEN o_totalprice < 30000 THEN 'known_no_doi' WHEN o_totalprice < 60000 THEN 'arxiv_only' WHEN o_totalprice < 90000 THEN 'published' END AS publication_status,
  CASE WHEN o_totalprice < 20000 THEN 'note' END AS editor_note, o_custkey AS user_id, o_orderstatus AS list_name FROM orders),
kept AS (SELECT id AS old_id, first_value(id) OVER (PARTITION BY base_id ORDER BY coalesce(updated_date, published_date) DESC, id DESC) AS keep_id FROM papers),
keywords AS (SELECT l_orderkey AS paper_id, l_partkey AS keyword_id, CASE min(l_returnflag) WHEN 'A' THEN 'auto' WHEN 'N' THEN 'manual' ELSE 'system' END AS source FROM lineitem GROUP BY ALL),
candidates AS (SELECT min((l_partkey * 10 + l_suppkey % 10) * 1000000000 + l_orderkey) AS candidate_id, l_orderkey AS paper_id, '10.9/' || (l_partkey % 50) AS doi, max(l_discount) AS confidence,
  CASE min(l_returnflag) WHEN 'A' THEN 'approved' WHEN 'N' THEN 'pending' ELSE 'rejected' END AS status, max(CASE WHEN l_linestatus = 'F' THEN cast(l_shipdate AS DATE) END) AS reviewed_at FROM lineitem GROUP BY paper_id, doi),
tags AS (SELECT l_orderkey AS paper_id, l_suppkey % 5 AS tag_id, min(cast(l_shipdate AS DATE)) AS created_at FROM lineitem GROUP BY ALL),
authors AS (SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber) AS author_order FROM lineitem GROUP BY ALL),
f_papers AS (SELECT k.keep_id, min(created_at) AS created_at, max(updated_at) AS updated_at, max(nullif(doi, '')) AS doi, max(list_position(['skipped', 'auto', 'arxiv', 'verified'], doi_status)) AS s, max(doi_confidence) AS doi_confidence,
  max(doi_checked_at) AS doi_checked_at, max(nullif(publication_url, '')) AS publication_url, max(nullif(publication_venue_key, '')) AS publication_venue_key, max(list_position(['arxiv_only', 'known_no_doi', 'published'], publication_status)) AS p, max(nullif(editor_note, '')) AS editor_note
  FROM papers JOIN kept k ON k.old_id = id GROUP BY ALL),
f_tags AS (SELECT keep_id AS paper_id, tag_id, created_at FROM tags JOIN kept ON old_id = paper_id QUALIFY row_number() OVER (PARTITION BY keep_id, tag_id ORDER BY old_id <> keep_id, created_at) = 1),
f_keywords AS (SELECT keep_id AS paper_id, keyword_id, ['auto', 'system', 'manual'][max(list_position(['auto', 'system', 'manual'], source))] AS source FROM keywords JOIN kept ON old_id = paper_id WHERE old_id = keep_id OR source <> 'auto' GROUP BY ALL),
f_candidates AS (SELECT arg_min(candidate_id, row(old_id <> keep_id, candidate_id)) AS candidate_id, keep_id AS paper_id, doi, max(confidence) AS confidence, ['rejected', 'pending', 'approved'][max(list_position(['rejected', 'pending', 'approved'], status))] AS status,
  arg_min(reviewed_at, row(old_id <> keep_id, candidate_id)) FILTER (reviewed_at IS NOT NULL) AS reviewed_at FROM candidates JOIN kept ON old_id = paper_id GROUP BY keep_id, doi),
f_lists AS (SELECT p.user_id, p.list_name, q.arxiv_id, p.published_date AS added_at FROM papers p JOIN kept ON old_id = p.id JOIN papers q ON q.id = keep_id QUALIFY row_number() OVER (PARTITION BY p.user_id, p.list_name, q.arxiv_id ORDER BY old_id <> keep_id, p.published_date) = 1),
f_authors AS (SELECT a.* FROM authors a JOIN kept ON old_id = paper_id WHERE old_id = keep_id)
"""


def _shown(rows):
    """Dates as text, as the SQL shows them."""
    return rows.select(*(F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in rows.dtypes))


def _kept(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    return tables, identity.kept_rows(tables["papers"])


@query(_ARCHIVE + """SELECT p.id, p.base_id, p.arxiv_id, cast(p.published_date AS VARCHAR) AS published_date, cast(p.updated_date AS VARCHAR) AS updated_date, cast(f.created_at AS VARCHAR) AS created_at, cast(f.updated_at AS VARCHAR) AS updated_at, coalesce(p.doi, f.doi) AS doi,
CASE WHEN p.doi IS NULL AND f.doi IS NOT NULL THEN ['skipped', 'auto', 'arxiv', 'verified'][f.s] ELSE coalesce(p.doi_status, ['skipped', 'auto', 'arxiv', 'verified'][f.s]) END AS doi_status, coalesce(p.doi_confidence, f.doi_confidence) AS doi_confidence,
cast(coalesce(p.doi_checked_at, f.doi_checked_at) AS VARCHAR) AS doi_checked_at, coalesce(p.publication_url, f.publication_url) AS publication_url, coalesce(p.publication_venue_key, f.publication_venue_key) AS publication_venue_key,
coalesce(p.publication_status, ['arxiv_only', 'known_no_doi', 'published'][f.p]) AS publication_status, coalesce(p.editor_note, f.editor_note) AS editor_note FROM f_papers f JOIN papers p ON p.id = f.keep_id""")  # fmt: skip
def identity_papers(spark, sf_dir):
    """Kept revisions with the metadata of the others."""
    tables, kept = _kept(spark, sf_dir)
    return _shown(identity.fold_papers(tables["papers"], kept))


@query(_ARCHIVE + "SELECT * REPLACE (cast(created_at AS VARCHAR) AS created_at) FROM f_tags")
def identity_tags(spark, sf_dir):
    tables, kept = _kept(spark, sf_dir)
    return _shown(identity.fold_tags(tables["tags"], kept))


@query(_ARCHIVE + "FROM f_keywords")
def identity_keywords(spark, sf_dir):
    tables, kept = _kept(spark, sf_dir)
    return identity.fold_keywords(tables["keywords"], kept)


@query(_ARCHIVE + "SELECT * REPLACE (cast(reviewed_at AS VARCHAR) AS reviewed_at) FROM f_candidates")
def identity_candidates(spark, sf_dir):
    tables, kept = _kept(spark, sf_dir)
    return _shown(identity.fold_candidates(tables["candidates"], kept))


@query(_ARCHIVE + "SELECT * REPLACE (cast(added_at AS VARCHAR) AS added_at) FROM f_lists")
def identity_lists(spark, sf_dir):
    tables, kept = _kept(spark, sf_dir)
    return _shown(identity.rekey_lists(tables["lists"], tables["papers"], kept))


@query(_ARCHIVE + """SELECT 'papers' AS name, count(*) AS n FROM f_papers UNION ALL SELECT 'tags', count(*) FROM f_tags UNION ALL SELECT 'keywords', count(*) FROM f_keywords UNION ALL SELECT 'candidates', count(*) FROM f_candidates
UNION ALL SELECT 'lists', count(*) FROM f_lists UNION ALL SELECT 'authors', count(*) FROM f_authors UNION ALL SELECT 'categories', count(*) FROM f_papers UNION ALL SELECT 'stats', 1""")  # fmt: skip
def identity_migration(spark, sf_dir):
    """Rows of each table after the whole migration was committed as one version.

    Lines are dealt by their order once, and what hangs on papers is written by paper: none of it is shuffled again to group lines or to find the kept revision.
    """
    store = Snapshots(spark, f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}")
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("l_shipdate")]
    lines = bucketed(table(spark, sf_dir, "lineitem").select(*columns), "lines", "l_orderkey")
    before = store.commit(_tables(spark, sf_dir, lines), expected=0, keys={"papers": "id"} | dict.fromkeys(["tags", "keywords", "candidates", "authors"], "paper_id"))
    remove(lines)
    tables = {name: store.read(name, before) for name in store.folders(before)}
    after = store.commit(identity.migrate(tables), expected=before)
    counts = [store.read(name, after).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in store.folders(after)]
    out = counts[0]
    for more in counts[1:]:
        out = out.union(more)
    return out
