"""Decisions on proposed identifiers, as columns over scores and conflicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least scores.
EVIDENCE, NEAR_TITLE, NEAR_AUTHORS, NEAR_SCORE = 0.85, 0.98, 0.95, 0.95
HIGH_SCORE, HIGH_TITLE, HIGH_AUTHORS = 0.84, 0.78, 0.95


def decision(queued: Column, linked: Column, queued_conflict: Column, linked_conflict: Column, stored: Column, linked_score: Column, title: Column, coverage: Column, exact_title: Column) -> Column:
    """What to do with a queued identifier, given what the registry links (null or a preprint's: nothing)."""
    near = (title >= NEAR_TITLE) & (coverage >= NEAR_AUTHORS) & (stored >= NEAR_SCORE)
    alone = (
        F.when(~queued_conflict & (exact_title | near) & (stored >= EVIDENCE), "metadata_exact")
        .when(~queued_conflict & (stored >= HIGH_SCORE) & (title >= HIGH_TITLE) & (coverage >= HIGH_AUTHORS), "review_high_evidence")
        .otherwise("unresolved")
    )
    same = F.when(queued_conflict, "review_exact_conflict").when(F.greatest(stored, linked_score) >= EVIDENCE, "approve_confirmed").otherwise("review_exact_weak_metadata")
    other = F.when(linked_score < EVIDENCE, "review_disagreement").when(linked_conflict, "review_replacement_conflict").otherwise("replacement_confirmed")
    none = linked.isNull() | linked.startswith("10.48550/arxiv.")
    return F.when(none, alone).when(linked == queued, same).otherwise(other)


def reference_match(year: Column, volume: Column, locator: Column, has_locator: Column, container: Column) -> Column:
    """Whether a free-form journal reference fits a registry record."""
    by_page = locator & (volume | (container >= 0.40))
    by_volume = ~has_locator & volume & (container >= 0.80)
    return year & (by_page | by_volume)


def confidence(record_score: Column, paper_year: Column, record_year: Column, has_journal: Column) -> Column:
    """Record score, nearness of years and a journal's name, 80 to 10 to 10."""
    apart = F.abs(paper_year - record_year)
    year = F.when(apart.isNull(), 0.3).when(apart <= 1, 1.0).when(apart <= 2, 0.5).otherwise(0.0)
    return F.bround(0.8 * record_score + 0.1 * year + 0.1 * F.when(has_journal, 1.0).otherwise(0.5), 3)
