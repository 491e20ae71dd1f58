"""Collects the named queries and their SQL from the modules of this package."""

from __future__ import annotations

from folioscope.plans import documents, editing, enrichment, linkage, list_edits, listings, lookup, marks, merges, mining, passes, personal, retagging, review, rollups, search, streams, suggest, transitions

MODULES: list = [listings, rollups, search, personal, transitions, mining, linkage, review, editing, enrichment, lookup, list_edits, passes, merges, suggest, retagging, documents, marks, streams]


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.registry.queries
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        found |= module.registry.sql
    return found
