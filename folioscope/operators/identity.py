"""Revisions of one work become one row: its newest revision stays, and what hangs on the others moves to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.stored import bucketed

#: States from weak to strong.
DOI_STATES = ["skipped", "auto", "arxiv", "verified"]
PUBLICATION_STATES = ["arxiv_only", "known_no_doi", "published"]
CANDIDATE_STATES = ["rejected", "pending", "approved"]
SOURCES = ["auto", "system", "manual"]
#: Metadata that the kept row takes from others only where it has none.
FILLED = ["doi_confidence", "doi_checked_at", "publication_url", "publication_venue_key", "publication_status", "editor_note"]


def strongest(state: Column, states: list[str]) -> Column:
    """Aggregate: the strongest known state; null if there is none."""
    listed = F.array(*map(F.lit, states))
    place = F.array_position(listed, state)
    return F.get(listed, F.max(F.when(place > 0, place)).cast("int") - 1)


def kept_rows(papers: DataFrame) -> DataFrame:
    """(old_id, keep_id): every paper and the newest revision of its base, the greater id of equally new ones."""
    newest = F.max_by("id", F.struct(F.coalesce("updated_date", "published_date"), "id")).over(Window.partitionBy("base_id"))
    return papers.where("base_id IS NOT NULL").select(F.col("id").alias("old_id"), newest.alias("keep_id"))


def fold_papers(papers: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept papers with what older revisions know; a doi brings its group's strongest state along."""
    present = lambda c: F.max(F.nullif(F.col(c), F.lit("")))
    found = papers.join(kept, papers["id"] == kept["old_id"]).repartition("keep_id").groupBy("keep_id").agg(
        F.min("created_at").alias("m_created_at"), F.max("updated_at").alias("m_updated_at"), present("doi").alias("m_doi"), strongest(F.col("doi_status"), DOI_STATES).alias("m_doi_status"),
        F.max("doi_confidence").alias("m_doi_confidence"), F.max("doi_checked_at").alias("m_doi_checked_at"), present("publication_url").alias("m_publication_url"),
        present("publication_venue_key").alias("m_publication_venue_key"), strongest(F.col("publication_status"), PUBLICATION_STATES).alias("m_publication_status"), present("editor_note").alias("m_editor_note"),
    )
    own = papers.join(found, papers["id"] == found["keep_id"])
    status = F.when(F.col("doi").isNull() & F.col("m_doi").isNotNull(), F.col("m_doi_status")).otherwise(F.coalesce("doi_status", "m_doi_status"))
    new = {"created_at": F.col("m_created_at"), "updated_at": F.col("m_updated_at"), "doi_status": status, "doi": F.coalesce("doi", "m_doi")} | {c: F.coalesce(c, f"m_{c}") for c in FILLED}
    return own.select(*(new[c].alias(c) if c in new else F.col(c) for c in papers.columns))


def _moved(children: DataFrame, kept: DataFrame, key: str, stays: Column | None = None) -> DataFrame:
    """children with paper_id, the paper they belong to now, and whether it is another than before (_other); those of unknown papers are their own.

    Of the others those that stays tells are kept.
    They are dealt by paper_id and key as they are: hardly any two rows of a task go together, so grouping before that would only widen them.
    """
    moved = children.join(kept.withColumnsRenamed({"old_id": "paper_id", "keep_id": "_keep"}), "paper_id", "left").withColumn("_keep", F.coalesce("_keep", "paper_id"))
    placed = moved.withColumn("_other", F.col("paper_id") != F.col("_keep")).withColumn("paper_id", F.col("_keep")).drop("_keep")
    return (placed if stays is None else placed.where(~F.col("_other") | stays)).repartition("paper_id", key)


def fold_tags(tags: DataFrame, kept: DataFrame) -> DataFrame:
    """(paper_id, tag_id, created_at): one of each; the kept paper's own wins, then the earliest."""
    first = F.min_by("created_at", F.struct("_other", "created_at"))
    return _moved(tags, kept, "tag_id").groupBy("paper_id", "tag_id").agg(first.alias("created_at"))


def fold_keywords(links: DataFrame, kept: DataFrame) -> DataFrame:
    """(paper_id, keyword_id, source): manual and system links of older revisions move, automatic ones go; the strongest source stays."""
    return _moved(links, kept, "keyword_id", F.col("source").isin("manual", "system")).groupBy("paper_id", "keyword_id").agg(strongest(F.col("source"), SOURCES).alias("source"))


def fold_candidates(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """(candidate_id, paper_id, doi, confidence, status, reviewed_at): greatest confidence, strongest state, first review.

    The row of the kept paper comes first, then the others by candidate_id.
    """
    place = F.struct("_other", "candidate_id")
    reviewed = F.min_by("reviewed_at", F.when(F.col("reviewed_at").isNotNull(), place))
    folded = _moved(candidates, kept, "doi").groupBy("paper_id", "doi").agg(
        F.min_by("candidate_id", place).alias("candidate_id"), F.max("confidence").alias("confidence"), strongest(F.col("status"), CANDIDATE_STATES).alias("status"), reviewed.alias("reviewed_at")
    )
    return folded.select(*candidates.columns)


def rekey_lists(lists: DataFrame, papers: DataFrame, kept: DataFrame) -> DataFrame:
    """(user_id, list_name, arxiv_id, added_at): saves name the kept revision; a save that was there wins, then the earliest."""
    names = papers.select(F.col("id"), "arxiv_id")
    moves = kept.where("old_id <> keep_id").join(names.withColumnsRenamed({"id": "old_id"}), "old_id").join(names.withColumnsRenamed({"id": "keep_id", "arxiv_id": "_new"}), "keep_id")
    seen = lists.join(moves.select("arxiv_id", "_new"), "arxiv_id", "left")
    placed = seen.select("user_id", "list_name", F.coalesce("_new", "arxiv_id").alias("arxiv_id"), "added_at", F.col("_new").isNotNull().alias("_other"))
    first = F.min_by("added_at", F.struct("_other", "added_at"))
    return placed.repartition("user_id", "list_name", "arxiv_id").groupBy("user_id", "list_name", "arxiv_id").agg(first.alias("added_at"))


def migrate(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after the migration: papers, tags, keywords, candidates, lists, authors, categories and stats.

    Authors and categories are the kept revision's own; stats counts papers and authors and has the latest date.
    """
    papers = tables["papers"]
    kept = bucketed(kept_rows(papers), "kept", "old_id")  # every table asks for it
    gone = kept.where("old_id <> keep_id").select(F.col("old_id").alias("paper_id"))
    people = tables["authors"].join(gone, "paper_id", "left_anti")
    own = papers.join(kept.where("old_id = keep_id"), F.col("id") == F.col("old_id"), "left_semi")
    stats = own.agg(F.count("*").alias("paper_count"), F.max("published_date").alias("latest_date")).join(F.broadcast(tables["authors"].agg(F.countDistinct("author_id").alias("author_count"))))
    return {
        "papers": fold_papers(papers, kept),
        "tags": fold_tags(tables["tags"], kept),
        "keywords": fold_keywords(tables["keywords"], kept),
        "candidates": fold_candidates(tables["candidates"], kept),
        "lists": rekey_lists(tables["lists"], papers, kept),
        "authors": people,
        "categories": tables["categories"].join(gone, "paper_id", "left_anti"),
        "stats": stats,
    }
