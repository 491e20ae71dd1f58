"""Triage of all pending candidates, and its decisions applied to papers and candidates.

The tables hold no outside records, so scores, links and live records are read from a line's own figures; conflicts, guards
and the order of the passes are those of the state itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import evidence
from folioscope.operators.replay import PASSES, apply_decisions
from folioscope.operators.stored import written
from folioscope.operators.triage import decision
from folioscope.plans.registry import Registry
from folioscope.plans.relations import table

registry = Registry()
query = registry.query

#: Of a conflict: how sure the assigned paper is, and by how much it must be surer than the candidate.
ASSIGNED_SCORE, MARGIN = 0.95, 0.15


def _state(spark, sf_dir):
    """(papers, proposals): urgent papers have the first of their identifiers; a proposal is pending while a line of it is open."""
    lines = table(spark, sf_dir, "lineitem")
    number = F.col("l_partkey") * 10 + F.col("l_suppkey") % 10
    proposals = lines.groupBy(F.col("l_orderkey").alias("paper_id"), number.alias("number")).agg(
        F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"), F.max("l_quantity").alias("quantity"), F.min("l_linenumber").alias("line"),
        F.min("l_returnflag").alias("flag"), F.bool_or(F.col("l_linestatus") == "O").alias("open"), F.min(F.year("l_shipdate")).alias("shipped"),
    )
    doi = lambda n: F.concat(F.lit("10."), n.cast("string"))
    linked = F.when(F.col("flag") == "A", doi(F.col("number"))).when(F.col("flag") == "N", doi(F.col("number") + 1))
    proposals = proposals.select((F.col("number") * 1_000_000_000 + F.col("paper_id")).alias("candidate_id"), "paper_id", doi(F.col("number")).alias("doi"), linked.alias("linked_doi"), *proposals.columns[2:])
    firsts = proposals.groupBy("paper_id").agg(F.min_by("doi", "candidate_id").alias("first"))
    orders = table(spark, sf_dir, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    reference = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), "Journal of Integer Sequences, Vol. 9").otherwise(F.concat(F.lit("J. "), "o_orderpriority"))
    papers = orders.select(F.col("o_orderkey").alias("paper_id"), urgent.alias("urgent"), reference.alias("journal_ref"), F.year("o_orderdate").alias("year"))
    papers = papers.join(firsts, "paper_id", "left").withColumn("doi", F.when(F.col("urgent"), F.col("first"))).withColumn("doi_status", F.when(F.col("doi").isNotNull(), "verified"))
    return papers.withColumn("doi_confidence", F.when(F.col("doi").isNotNull(), 1.0)).drop("first"), proposals


def _decided(papers, proposals):
    """(candidate_id, decision, linked_doi, confidence) of pending proposals, by the rules of triage and of live records."""
    assigned = papers.where("doi IS NOT NULL").groupBy("doi").agg(F.min("paper_id").alias("low"), F.max("paper_id").alias("high"))
    pending = proposals.where("open")
    queued = pending.groupBy("doi").agg((F.min("paper_id") != F.max("paper_id")).alias("several"))
    conflicts = assigned.select("doi").union(queued.where("several").select("doi")).distinct()
    seen = pending.join(papers.select("paper_id", "journal_ref", "year"), "paper_id")
    seen = seen.join(conflicts.withColumn("q_conflict", F.lit(True)), "doi", "left").join(conflicts.select(F.col("doi").alias("linked_doi"), F.lit(True).alias("l_conflict")), "linked_doi", "left").join(assigned, "doi", "left")
    c, sure = F.col, lambda name: F.coalesce(F.col(name), F.lit(False))
    stored, link, title, cover = F.round(c("discount") * 10, 2), F.round(1 - c("tax") * 10, 2), c("quantity") / 50, F.round(1 - c("discount") * 2, 2)
    live = F.when(c("line") % 2 == 1, F.when(c("flag") == "N", c("linked_doi")).otherwise(c("doi")))
    resolved = F.when(c("line") % 3 == 0, c("linked_doi"))
    score = F.round(0.8 + c("tax") * 2.5, 3)
    first = decision(c("doi"), c("linked_doi"), sure("q_conflict"), sure("l_conflict"), stored, link, title, cover, c("line") == 1)
    elsewhere = F.coalesce((c("low") != c("paper_id")) | (c("high") != c("paper_id")), F.lit(False))
    better = sure("q_conflict") & elsewhere & (F.lit(ASSIGNED_SCORE) >= stored + MARGIN)
    # One column after another: each rule reads the decision before it more than once.
    before = F.col("decision")
    decided = seen.withColumn("decision", first)
    for rule in (
        F.when(better, "reject_conflict_assigned_better").otherwise(before),
        evidence.replacement(before, c("linked_doi"), live, score, resolved, score, c("line") == 6),
        evidence.metadata(before, c("doi"), live, score),
        evidence.exact_external(before, c("doi"), live, title, cover),
        evidence.journal(before, c("journal_ref"), sure("q_conflict"), F.coalesce(live == c("doi"), F.lit(False)), c("shipped") == c("year"), title, cover),
    ):
        decided = decided.withColumn("decision", rule)
    sureness = (
        F.when(c("decision") == "approve_confirmed", F.greatest(stored, link))
        .when(c("decision").isin("approve_replacement", "approve_metadata_exact"), score)
        .when(c("decision") == "approve_exact_external", evidence.external_confidence(stored, link, title, cover))
        .when(c("decision") == "approve_journal_reference", evidence.journal_confidence(title, cover))
    )
    return decided.select("candidate_id", "decision", "linked_doi", sureness.alias("confidence"))


def _stored(spark, sf_dir):
    """(papers, proposals, decided), each written once: triage, the rounds and the results read them several times."""
    papers, proposals = _state(spark, sf_dir)
    proposals = written(proposals, "proposals")
    papers = written(papers, "papers")
    return papers, proposals, written(_decided(papers, proposals), "decided")


def _replayed(papers, proposals, decided):
    status = F.when(F.col("open"), "pending").otherwise("rejected")
    candidates = proposals.select("candidate_id", "paper_id", "doi", status.alias("status"), F.round(F.col("discount") * 10, 2).alias("confidence"))
    held = papers.select("paper_id", "doi", "doi_status", "doi_confidence", "journal_ref")
    return apply_decisions(held, candidates, decided)


_STATE = """WITH p0 AS (SELECT l_orderkey AS paper_id, l_partkey * 10 + l_suppkey % 10 AS number, max(l_discount) AS discount, max(l_tax) AS tax, max(l_quantity) AS quantity,
  min(l_linenumber) AS line, min(l_returnflag) AS flag, bool_or(l_linestatus = 'O') AS open, min(year(l_shipdate)) AS shipped FROM lineitem GROUP BY ALL),
proposals AS (SELECT number * 1000000000 + paper_id AS candidate_id, '10.' || number AS doi, CASE flag WHEN 'A' THEN '10.' || number WHEN 'N' THEN '10.' || (number + 1) END AS linked_doi, * FROM p0),
firsts AS (SELECT paper_id, min_by(doi, candidate_id) AS first FROM proposals GROUP BY ALL),
papers AS (SELECT o_orderkey AS paper_id, CASE WHEN o_orderpriority = '1-URGENT' THEN first END AS doi, o_orderpriority = '5-LOW' AND o_orderstatus = 'P' AS no_doi, year(o_orderdate) AS y
  FROM orders LEFT JOIN firsts ON firsts.paper_id = o_orderkey),
assigned AS (SELECT doi, min(paper_id) AS low, max(paper_id) AS high FROM papers WHERE doi IS NOT NULL GROUP BY ALL),
pending AS (SELECT * FROM proposals WHERE open),
conflicts AS (SELECT doi FROM assigned UNION SELECT doi FROM pending GROUP BY doi HAVING min(paper_id) <> max(paper_id)),
seen AS (SELECT s.*, p.no_doi, p.doi AS own, s.doi IN (FROM conflicts) AS qc, coalesce(linked_doi IN (FROM conflicts), false) AS lc, coalesce(a.low <> s.paper_id OR a.high <> s.paper_id, false) AS elsewhere,
  round(discount * 10, 2) AS stored, round(1 - tax * 10, 2) AS link, quantity / 50 AS title, round(1 - discount * 2, 2) AS cover, round(0.8 + tax * 2.5, 3) AS score,
  CASE WHEN line % 2 = 1 THEN CASE WHEN flag = 'N' THEN linked_doi ELSE s.doi END END AS live, CASE WHEN line % 3 = 0 THEN linked_doi END AS resolved, shipped = y AS fits
  FROM pending s JOIN papers p ON p.paper_id = s.paper_id LEFT JOIN assigned a ON a.doi = s.doi),
d1 AS (SELECT *, CASE WHEN qc AND elsewhere AND 0.95::DOUBLE >= stored + 0.15::DOUBLE THEN 'reject_conflict_assigned_better'
  WHEN linked_doi IS NULL THEN CASE WHEN NOT qc AND (line = 1 OR (title >= 0.98 AND cover >= 0.95 AND stored >= 0.95)) AND stored >= 0.85 THEN 'metadata_exact'
    WHEN NOT qc AND stored >= 0.84 AND title >= 0.78 AND cover >= 0.95 THEN 'review' ELSE 'unresolved' END
  WHEN linked_doi = doi THEN CASE WHEN qc THEN 'review' WHEN greatest(stored, link) >= 0.85 THEN 'approve_confirmed' ELSE 'weak' END
  WHEN link < 0.85 THEN 'review' WHEN lc THEN 'review' ELSE 'replacement' END AS v FROM seen),
d2 AS (SELECT *, CASE v WHEN 'replacement' THEN CASE WHEN coalesce(live, CASE WHEN line <> 6 THEN resolved END) = linked_doi AND score >= 0.85 THEN 'approve_replacement' END
  WHEN 'metadata_exact' THEN CASE WHEN live = doi AND score >= 0.95 THEN 'approve_metadata_exact' END
  WHEN 'weak' THEN CASE WHEN live = doi AND title >= 0.45 AND cover >= 0.80 THEN 'approve_exact_external' END ELSE v END AS w FROM d1),
decided AS (SELECT *, CASE WHEN no_doi THEN 'skip_known_doi_less' WHEN NOT qc AND live = doi AND fits AND title >= 0.45 AND cover >= 0.80 THEN 'approve_journal_reference' ELSE w END AS decision FROM d2),
steps AS (SELECT candidate_id, paper_id, decision, list_position(['approve_confirmed', 'approve_replacement', 'approve_metadata_exact', 'reject_conflict_assigned_better', 'approve_exact_external', 'approve_journal_reference', 'skip_known_doi_less'], decision) AS pass,
  CASE decision WHEN 'approve_replacement' THEN linked_doi WHEN 'skip_known_doi_less' THEN NULL ELSE doi END AS target, own,
  CASE decision WHEN 'approve_confirmed' THEN greatest(stored, link) WHEN 'approve_replacement' THEN score WHEN 'approve_metadata_exact' THEN score
    WHEN 'approve_exact_external' THEN round_even(greatest(stored, link, (title + cover) / 2), 3) WHEN 'approve_journal_reference' THEN round_even(0.5 * title + 0.25 * cover + 0.25, 3) END AS confidence FROM decided),
rivals AS (SELECT s.candidate_id, list(q.paper_id) AS rivals FROM steps s JOIN pending q ON q.doi = s.target AND q.paper_id <> s.paper_id WHERE decision = 'approve_replacement' GROUP BY ALL),
numbered AS (SELECT s.*, row_number() OVER (ORDER BY pass, s.candidate_id) AS n, coalesce(rivals, []) AS rivals, coalesce(a.low <> s.paper_id OR a.high <> s.paper_id, false) AS elsewhere
  FROM steps s LEFT JOIN rivals r ON r.candidate_id = s.candidate_id LEFT JOIN assigned a ON a.doi = s.target
  WHERE pass IS NOT NULL AND (own IS NULL OR decision LIKE 'reject%') AND (NOT coalesce(elsewhere, false) OR decision LIKE 'reject%')),
listed AS (SELECT {'papers': []::BIGINT[], 'targets': []::VARCHAR[], 'applied': []::BIGINT[], 'pass': 0, 'n': 0, 'paper': 0, 'target': '', 'elsewhere': false, 'rivals': []::BIGINT[]} AS begin,
  list({'papers': []::BIGINT[], 'targets': []::VARCHAR[], 'applied': []::BIGINT[], 'pass': pass, 'n': n, 'paper': paper_id, 'target': target, 'elsewhere': elsewhere, 'rivals': rivals} ORDER BY n) AS steps FROM numbered),
folded AS (SELECT list_reduce([begin] || steps, lambda s, x: CASE
  WHEN list_contains(s.papers, x.paper) THEN s
  WHEN x.pass = 4 THEN CASE WHEN x.elsewhere OR list_contains(s.targets, x.target) THEN struct_update(s, applied := s.applied || [x.n]) ELSE s END
  WHEN x.pass < 7 AND list_contains(s.targets, x.target) THEN s
  WHEN x.pass = 2 AND len(list_filter(x.rivals, lambda q: NOT list_contains(s.papers, q))) > 0 THEN s
  ELSE struct_update(s, papers := s.papers || [x.paper], targets := s.targets || CASE WHEN x.pass < 7 THEN [x.target] ELSE [] END, applied := s.applied || [x.n]) END).applied AS applied FROM listed),
applied AS (SELECT * FROM numbered WHERE n IN (SELECT unnest(applied) FROM folded)),
writes AS (SELECT * FROM applied WHERE pass <> 4)
"""


@query(_STATE + """SELECT p.paper_id, coalesce(p.doi, w.target) AS doi, CASE WHEN p.doi IS NOT NULL THEN 'verified' WHEN w.target IS NOT NULL THEN 'auto' WHEN w.n IS NOT NULL THEN 'skipped' END AS doi_status,
  CASE WHEN p.doi IS NOT NULL THEN 1.0::DOUBLE ELSE w.confidence END AS doi_confidence FROM papers p LEFT JOIN writes w ON w.paper_id = p.paper_id""")  # fmt: skip
def apply_passes(spark, sf_dir):
    """All papers after the seven passes over all pending proposals."""
    return _replayed(*_stored(spark, sf_dir)).papers.select("paper_id", "doi", "doi_status", "doi_confidence")


@query(_STATE + """SELECT c.paper_id, c.doi, CASE WHEN c.open AND c.doi = w.target AND w.pass <> 2 OR c.doi = w.target AND w.pass = 2 THEN 'approved' WHEN NOT c.open THEN 'rejected' WHEN w.n IS NOT NULL OR r.n IS NOT NULL THEN 'rejected' ELSE 'pending' END AS status,
  CASE WHEN c.doi = w.target AND w.pass = 2 THEN w.confidence ELSE round(c.discount * 10, 2) END AS confidence
FROM proposals c LEFT JOIN writes w ON w.paper_id = c.paper_id LEFT JOIN applied r ON r.candidate_id = c.candidate_id AND r.pass = 4
UNION ALL SELECT w.paper_id, w.target, 'approved', w.confidence FROM writes w WHERE w.pass = 2 AND NOT EXISTS (FROM proposals c WHERE c.paper_id = w.paper_id AND c.doi = w.target)""")  # fmt: skip
def apply_passes_candidates(spark, sf_dir):
    """All candidates after the seven passes, with those that replacements added."""
    return _replayed(*_stored(spark, sf_dir)).candidates.select("paper_id", "doi", "status", "confidence")


@query(_STATE + "SELECT decision, count(*) AS decided, count(a.n) AS applied FROM steps LEFT JOIN applied a USING (candidate_id, decision) WHERE steps.pass IS NOT NULL GROUP BY decision")
def apply_passes_report(spark, sf_dir):
    """How many decisions of each pass there were, and how many held when their turn came."""
    papers, proposals, every = _stored(spark, sf_dir)
    decided = every.where(F.col("decision").isin(PASSES)).select("candidate_id", "decision")
    applied = _replayed(papers, proposals, every).applied.select("candidate_id", F.lit(1).alias("held"))
    return decided.join(applied, "candidate_id", "left").groupBy("decision").agg(F.count("*").alias("decided"), F.count("held").alias("applied"))
