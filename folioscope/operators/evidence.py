"""Decisions renewed by live registry records, as columns: an earlier decision changes only where its rule applies.

A record that was not found is null in all that is read from it; every rule treats null as no evidence.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a journal's name that don't count, and a journal that has no DOIs.
CONTAINER_STOPWORDS = ["a", "an", "and", "for", "in", "of", "on", "series", "the"]
JOURNALS_WITHOUT_DOI = ["journal of integer sequences"]
#: Signs of a repository's copy.
REPOSITORY_SIGNS = ["digital repository", "institutional repository", "/handle/"]
#: Least scores.
REPLACEMENT, METADATA, WEAK_TITLE, WEAK_AUTHORS = 0.85, 0.95, 0.45, 0.80

#: Accented small letters of the Latin blocks and their bases; a table keeps names in the JVM, also inside higher-order functions.
ACCENTED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xE0, 0x180)) if c.islower() and unicodedata.decomposition(c)[:1] not in ("", "<")}

_sure = lambda c: F.coalesce(c, F.lit(False))


def is_repository(publisher: Column, container: Column, url: Column) -> Column:
    text = F.lower(F.concat_ws(" ", publisher, container, url))
    found = F.lit(False)
    for sign in REPOSITORY_SIGNS:
        found = found | text.contains(sign)
    return found


def replacement(before: Column, linked: Column, registry_doi: Column, registry_score: Column, resolver_doi: Column, resolver_score: Column, repository: Column) -> Column:
    """A replacement needs a record of the linked identifier: the registry's, or else the resolver's that is no repository's."""
    fits = lambda doi, score: _sure((doi == linked) & (score >= REPLACEMENT))
    by_registry = F.when(fits(registry_doi, registry_score), "approve_replacement").otherwise("review_replacement_crossref_mismatch")
    by_resolver = F.when(resolver_doi.isNull(), "review_replacement_no_resolver_metadata").when(_sure(repository), "review_replacement_repository")
    by_resolver = by_resolver.when(fits(resolver_doi, resolver_score), "approve_replacement").otherwise("review_replacement_resolver_mismatch")
    return F.when(before == "replacement_confirmed", F.when(registry_doi.isNotNull(), by_registry).otherwise(by_resolver)).otherwise(before)


def metadata(before: Column, queued: Column, registry_doi: Column, score: Column) -> Column:
    """Exact stored metadata must hold against the live record."""
    live = F.when(registry_doi.isNull(), "review_metadata_no_crossref").when(_sure((registry_doi == queued) & (score >= METADATA)), "approve_metadata_exact")
    return F.when(before == "metadata_exact", live.otherwise("review_metadata_crossref_mismatch")).otherwise(before)


def exact_external(before: Column, queued: Column, live_doi: Column, title: Column, coverage: Column) -> Column:
    """A weak exact link is approved by the live title and authors."""
    enough = _sure((live_doi == queued) & (title >= WEAK_TITLE) & (coverage >= WEAK_AUTHORS))
    live = F.when(live_doi.isNull(), "review_exact_no_live_metadata").when(enough, "approve_exact_external").otherwise("review_exact_live_metadata_mismatch")
    return F.when(before == "review_exact_weak_metadata", live).otherwise(before)


def external_confidence(stored: Column, linked: Column, title: Column, coverage: Column) -> Column:
    return F.bround(F.greatest(stored, linked, (title + coverage) / 2), 3)


def plain_words(text: Column) -> Column:
    """Text without the accents of Latin letters, marks and capitals, its words between single blanks, and one blank at each end."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # A table of letters is looked up for each character, so ASCII goes without.
    folded = F.when(F.length(low) == F.octet_length(low), low).otherwise(F.translate(low, "".join(ACCENTED), "".join(ACCENTED.values())))
    words = F.regexp_replace(folded, "[^a-z0-9]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def locators(text: Column) -> Column:
    """Numbers with the letters before them, without points: pages and article numbers."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?<![a-z])[a-z]*+[0-9]++(?:\.[0-9]++)*+"), F.lit(0))
    return F.transform(found, lambda t: F.replace(t, F.lit("."), F.lit("")))


def record_reading(volumes: Column, pages: Column, containers: Column) -> Column:
    """struct(volumes, locators, has_locator, containers): what a record's lists of strings say, read once for all references to it."""
    listed = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")
    counted = lambda name: F.array_distinct(F.filter(F.split(F.trim(plain_words(name)), " "), lambda w: (w != "") & ~w.isin(CONTAINER_STOPWORDS)))
    return F.struct(
        F.filter(F.transform(listed(volumes), plain_words), lambda v: F.trim(v) != "").alias("volumes"),
        F.filter(F.transform(listed(pages), lambda p: F.get(locators(p), F.lit(0))), lambda p: F.length(p) >= 2).alias("locators"),
        (F.size(listed(pages)) > 0).alias("has_locator"),
        F.filter(F.transform(listed(containers), counted), lambda name: F.size(name) > 0).alias("containers"),
    )


def reading_evidence(reference: Column, years: Column, reading: Column) -> Column:
    """reference_evidence of a record that record_reading has read."""
    share = lambda name, whole: F.size(F.array_intersect(name, whole)) / F.size(name)
    listed = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")

    def against(words):
        whole = F.split(F.trim(words), " ")
        return F.struct(
            F.exists(listed(years), lambda y: _sure(reference.contains(y))).alias("year"),
            F.exists(reading["volumes"], words.contains).alias("volume"),
            F.coalesce(F.arrays_overlap(reading["locators"], locators(reference)), F.lit(False)).alias("locator"),
            reading["has_locator"].alias("has_locator"),
            F.coalesce(F.array_max(F.transform(reading["containers"], lambda name: share(name, whole))), F.lit(0.0)).alias("container"),
        )

    return F.element_at(F.transform(F.array(plain_words(reference)), against), 1)


def reference_evidence(reference: Column, years: Column, volumes: Column, pages: Column, containers: Column) -> Column:
    """struct(year, volume, locator, has_locator, container) of a free-form reference against a record's lists of strings.

    container is the greatest share of a journal name's words that the reference has. Empty lists and a null
    reference give no evidence.
    """
    return F.element_at(F.transform(F.array(record_reading(volumes, pages, containers)), lambda reading: reading_evidence(reference, years, reading)), 1)


def journal(before: Column, reference: Column, conflict: Column, same: Column, fits: Column, title: Column, coverage: Column) -> Column:
    """A journal reference may overrule any earlier decision: a journal without DOIs is skipped first, then a fitting record approves."""
    words = plain_words(reference)
    skipped = F.lit(False)
    for name in JOURNALS_WITHOUT_DOI:
        skipped = skipped | words.contains(name)
    approved = _sure(~conflict & same & fits & (title >= WEAK_TITLE) & (coverage >= WEAK_AUTHORS))
    given = F.coalesce(reference, F.lit("")) != ""
    return F.when(given & skipped, "skip_known_doi_less").when(given & approved, "approve_journal_reference").otherwise(before)


def journal_confidence(title: Column, coverage: Column) -> Column:
    return F.bround(0.50 * title + 0.25 * coverage + 0.25, 3)
