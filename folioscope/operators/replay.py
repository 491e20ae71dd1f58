"""Review decisions applied to stored state: seven passes in order, every write guarded by what earlier ones left.

The passes are one sequence, by pass and candidate. Whether a decision applies depends on earlier ones only through
its paper (which takes one write) and its identifier (which goes to one paper). So decisions are settled in
rounds: those whose guard can't hold any more go first, all at once, and then every decision whose paper and
identifier no earlier open decision can write. What results is what one decision after another would give; the number
of rounds is that of a longest chain of decisions that wait for each other, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.evidence import JOURNALS_WITHOUT_DOI, plain_words
from folioscope.operators.stored import remove, written

#: The decisions that are applied, in the order of their passes.
PASSES = [
    "approve_confirmed", "approve_replacement", "approve_metadata_exact", "reject_conflict_assigned_better",
    "approve_exact_external", "approve_journal_reference", "skip_known_doi_less",
]
APPROVING = [p for p in PASSES if p.startswith("approve")]
REPLACING, REJECTING, SKIPPING = "approve_replacement", "reject_conflict_assigned_better", "skip_known_doi_less"


def _never() -> Column:
    """After all decisions."""
    return F.struct(F.lit(len(PASSES)).alias("pass"), F.lit(0).cast("long").alias("id"))


@dataclass
class Replayed:
    """State after all passes, and the decisions that were applied: (candidate_id, paper_id, decision, target, confidence)."""

    papers: DataFrame
    candidates: DataFrame
    applied: DataFrame


def without_doi(reference: Column) -> Column:
    """Whether a journal reference names a journal that has no identifiers."""
    found = F.lit(False)
    for name in JOURNALS_WITHOUT_DOI:
        found = found | plain_words(reference).contains(name)
    return found


def _first_two(rivals: DataFrame) -> DataFrame:
    """(target, top, other): of rows (target, rival, early) the greatest early with its rival, and the greatest of the other rivals."""
    top = rivals.groupBy("target").agg(F.max(F.struct("early", "rival")).alias("top"))
    others = rivals.join(top, "target").where("rival <> top.rival").groupBy("target").agg(F.max("early").alias("other"))
    return top.join(others, "target", "left")


def _round(open_: DataFrame, papers: DataFrame, pending: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, left) of the open decisions (order, candidate_id, paper_id, decision, target, confidence)."""
    # A paper has its identifier, or what was written to it; an identifier has its papers.
    written_ = done.where(F.col("decision") != REJECTING)
    changed = written_.select("paper_id").distinct()  # none of their candidates is pending any more
    taken = papers.where("doi IS NOT NULL").select("paper_id", F.lit(False).alias("_changed")).union(changed.withColumn("_changed", F.lit(True)))
    holders = papers.where("doi IS NOT NULL").select(F.col("doi").alias("target"), "paper_id").union(written_.where("target IS NOT NULL").select("target", "paper_id"))
    held = holders.groupBy("target").agg(F.min("paper_id").alias("_low"), F.max("paper_id").alias("_high"))
    elsewhere = F.coalesce((F.col("_low") != F.col("paper_id")) | (F.col("_high") != F.col("paper_id")), F.lit(False))
    seen = open_.join(taken, "paper_id", "left").join(held, "target", "left").withColumn("_elsewhere", elsewhere).drop("_low", "_high")
    approving = F.col("decision").isin(APPROVING)
    lost = F.when(F.col("decision") == REJECTING, F.coalesce("_changed", F.lit(False))).otherwise(F.col("_changed").isNotNull())
    alive = seen.where(~lost & ~(approving & F.col("_elsewhere"))).drop("_changed")

    first = lambda condition: F.min(F.when(condition, F.col("order")))
    by_paper = alive.groupBy("paper_id").agg(F.min("order").alias("_paper"), first(F.col("decision") != REJECTING).alias("_paper_write"))
    by_target = alive.where("target IS NOT NULL").groupBy("target").agg(F.min("order").alias("_target"), first(approving).alias("_target_write"), first(F.col("decision") == REPLACING).alias("_reads"))
    reads = by_target.where("_reads IS NOT NULL").select("target", "_reads")
    waiting = pending.select(F.col("doi").alias("target"), "paper_id").distinct().join(reads, "target").join(changed, "paper_id", "left_anti")
    # A replacement looks for other papers' pending candidates, so those papers' later writes wait for it.
    by_reader = waiting.groupBy("paper_id").agg(F.min("_reads").alias("_read"))
    rivals = waiting.select("target", F.col("paper_id").alias("rival"))
    early = by_paper.select(F.col("paper_id").alias("rival"), F.col("_paper_write").alias("early"))
    rivals = rivals.join(early, "rival", "left").withColumn("early", F.coalesce("early", _never()))
    judged = alive.join(by_paper, "paper_id", "left").join(by_target.drop("_reads"), "target", "left").join(by_reader, "paper_id", "left").join(_first_two(rivals), "target", "left")
    # Of the other papers that wait for a replacement's target the one whose first write comes last, if there is any.
    latest = F.when(F.col("decision") == REPLACING, F.when(F.col("top.rival") != F.col("paper_id"), F.col("top.early")).otherwise(F.col("other")))
    judged = judged.withColumn("_rival", latest)
    fails = F.coalesce(F.col("_rival") >= F.col("order"), F.lit(False))  # that paper's candidate stays pending until then
    not_before = lambda c: F.coalesce(F.col(c), _never()) >= F.col("order")
    free_to_write = not_before("_paper") & not_before("_target") & not_before("_read") & F.col("_rival").isNull()
    free = F.when(F.col("decision") == REJECTING, not_before("_paper_write") & not_before("_target_write")).otherwise(free_to_write)
    judged = judged.where(~fails).withColumn("_ready", free)
    applies = F.when(F.col("decision") == REJECTING, F.col("_elsewhere")).otherwise(F.lit(True))
    return judged.where(F.col("_ready") & applies).select(*done.columns), judged.where("NOT _ready").select(*open_.columns)


def apply_decisions(papers: DataFrame, candidates: DataFrame, decisions: DataFrame) -> Replayed:
    """Replays decisions over papers and candidates.

    papers: (paper_id, doi, doi_status, doi_confidence, journal_ref), one row for each paper. candidates: (candidate_id, paper_id, doi, status,
    confidence), one for each pair of paper and doi. decisions: (candidate_id, decision, linked_doi, confidence), one for each candidate; those not in PASSES, of
    unknown candidates, of candidates that aren't pending or of unknown papers change nothing.

    An approval needs a paper without doi and a doi that no other paper has; it gives the paper the doi with status auto, approves
    its candidate and rejects the paper's other pending ones. A replacement approves the linked doi instead, which no other paper may have
    pending; it rejects all pending candidates of the paper and adds or renews the approved one (an added one
    has no candidate_id). A rejected conflict needs another paper with the doi. A skip needs a paper whose journal has no identifiers; status
    becomes skipped and the pending candidates are rejected. Null dois hold nothing and match nothing.
    """
    order = F.struct((F.array_position(F.array(*map(F.lit, PASSES)), F.col("decision")) - 1).cast("int").alias("pass"), F.col("candidate_id").cast("long").alias("id"))
    # Every round reads these, so whatever they are made from is worked out once.
    pending = written(candidates.where("status = 'pending'").select("candidate_id", "paper_id", "doi"), "pending")
    holding = written(papers.where("doi IS NOT NULL").select("paper_id", "doi"), "holding")
    known = papers.select("paper_id", without_doi(F.col("journal_ref")).alias("_no_doi"))
    target = F.when(F.col("decision") == REPLACING, F.col("linked_doi")).when(F.col("decision") != SKIPPING, F.col("doi"))
    wanted = decisions.where(F.col("decision").isin(PASSES)).join(pending, "candidate_id").join(known, "paper_id")
    wanted = wanted.withColumn("target", target).withColumn("order", order)
    wanted = wanted.where(F.when(F.col("decision") == SKIPPING, F.col("_no_doi")).otherwise(F.col("target").isNotNull()))
    columns = ["candidate_id", "paper_id", "decision", "target", "confidence"]
    open_ = written(wanted.select("order", *columns), "open")
    done = written(open_.select(*columns).limit(0), "applied")
    while not open_.isEmpty():
        now, left = _round(open_, holding, pending, done)
        both = written(now.withColumn("_left", F.lit(False)).unionByName(left.withColumn("_left", F.lit(True)), allowMissingColumns=True), "round")
        before = (open_, done)
        done = written(done.unionByName(both.where("NOT _left").select(*columns)), "applied")
        open_ = written(both.where("_left").select("order", *columns), "open")
        for table in (*before, both):
            remove(table)
    for table in (pending, holding, open_):
        remove(table)
    return Replayed(_papers_after(papers, done), _candidates_after(candidates, done), done)


def _papers_after(papers: DataFrame, done: DataFrame) -> DataFrame:
    write = done.where(F.col("decision") != REJECTING).select("paper_id", F.col("target").alias("_doi"), F.col("confidence").alias("_confidence"), F.lit(True).alias("_written"))
    given = F.col("_written") & F.col("_doi").isNotNull()
    status = F.when(given, "auto").when(F.col("_written"), "skipped").otherwise(F.col("doi_status"))
    after = papers.join(write, "paper_id", "left").withColumns({"doi": F.coalesce("doi", "_doi"), "doi_status": status, "doi_confidence": F.when(given, F.col("_confidence")).otherwise(F.col("doi_confidence"))})
    return after.select(*papers.columns)


def _candidates_after(candidates: DataFrame, done: DataFrame) -> DataFrame:
    write = done.where(F.col("decision") != REJECTING).select("paper_id", F.col("target").alias("_doi"), F.col("confidence").alias("_confidence"), (F.col("decision") == REPLACING).alias("_replaced"))
    rejected = done.where(F.col("decision") == REJECTING).select("candidate_id", F.lit(True).alias("_rejected"))
    renewed = F.coalesce(F.col("doi") == F.col("_doi"), F.lit(False)) & ((F.col("status") == "pending") | F.col("_replaced"))
    status = F.when(renewed, "approved").when((F.col("status") == "pending") & (F.col("_replaced").isNotNull() | F.col("_rejected")), "rejected").otherwise(F.col("status"))
    after = candidates.join(write, "paper_id", "left").join(rejected, "candidate_id", "left")
    after = after.withColumns({"confidence": F.when(renewed & F.col("_replaced"), F.col("_confidence")).otherwise(F.col("confidence")), "status": status}).select(*candidates.columns)
    added = write.where("_replaced").join(candidates.select("paper_id", F.col("doi").alias("_doi")), ["paper_id", "_doi"], "left_anti")
    new = {"paper_id": F.col("paper_id"), "doi": F.col("_doi"), "status": F.lit("approved"), "confidence": F.col("_confidence")}
    return after.unionByName(added.select(*(new.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in candidates.schema)))
