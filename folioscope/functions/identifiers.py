"""Identifiers of preprints and publications, and the venues behind links."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Journals without DOIs by host and path.
VENUES = [
    ("jis", ["cs.uwaterloo.ca", "www.cs.uwaterloo.ca"], ["/journals/jis/"], "Journal of Integer Sequences"),
    ("slc", ["mat.univie.ac.at", "www.mat.univie.ac.at", "emis.de", "www.emis.de"], ["/~slc/", "/journals/slc/"], "Séminaire Lotharingien de Combinatoire"),
]
#: The forms of preprint ids and DOIs.
PREPRINT = r"(?:[0-9]{4}\.[0-9]{4,5}|[a-zA-Z.-]+/[0-9]{7})(?:[vV][0-9]+)?"
DOI = r"(?i)(10\.[0-9]{4,9}/[^\s<>\"{}|\\^`\[\]]+)"


def venue_label(publication: Column) -> Column:
    """The name of the venue behind a link of VENUES; null for other links and for DOIs."""
    host = F.lower(F.regexp_extract(publication, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    path = F.regexp_extract(publication, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    known = [F.when(host.isin(hosts) & reduce(or_, (F.startswith(path, F.lit(p)) for p in paths)), F.lit(label)) for _, hosts, paths, label in VENUES]
    return F.coalesce(*known)


def _empty_is_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def preprint_id(value: Column) -> Column:
    """The arXiv id in an id, a label or an arxiv.org link; null for links elsewhere and for anything else."""
    plain = F.rtrim(F.trim(F.trim(F.trim(value), F.lit("<>()[]{}")), F.lit("'\"")), F.lit(".,;"))
    plain = F.trim(F.regexp_replace(plain, r"^(?i)arxiv:", ""))
    linked = F.regexp_replace(plain, r"^(?i)(?=(www\.|export\.)?arxiv\.org/)|^(?=//)", "https://")
    return _let(F.regexp_replace(linked, "^https:////", "https://"), _preprint_in)


def _preprint_in(text: Column) -> Column:
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    path = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/*([^?#]*)", 1)
    inner = F.regexp_replace(F.try_url_decode(path), "^(abs|pdf|html|e-print|format)(/|$)", "")
    rest = _let(host, lambda h: F.when(h.endswith("arxiv.org"), inner).when(h != "", F.lit("")).otherwise(text))
    rest = F.rtrim(F.regexp_replace(F.trim(F.trim(rest), F.lit("/")), r"(?i)\.pdf$", ""), F.lit(".,;"))
    whole = lambda t: F.regexp_extract(t, f"^({PREPRINT})$", 1)
    inside = lambda t: F.regexp_extract(t, rf"(?<![A-Za-z0-9./-])({PREPRINT})(?![A-Za-z0-9./-])", 1)
    return _let(rest, lambda t: F.coalesce(_empty_is_null(whole(t)), _empty_is_null(inside(t))))


def base_and_version(value: Column) -> Column:
    """struct(base, version): version 1 where none is said; both null for no id."""

    def parts(found):
        version = F.regexp_extract(found, "(?i)v([0-9]+)$", 1)
        return F.struct(F.regexp_replace(found, "(?i)v[0-9]+$", "").alias("base"), F.when(version != "", version.cast("int")).when(found.isNotNull(), 1).alias("version"))

    return _let(preprint_id(value), parts)


def doi_in(value: Column) -> Column:
    """A DOI anywhere in text or in a doi.org link, as written; null without one."""
    text = F.regexp_replace(F.trim(value), r"^(?i)doi:\s*", "")
    linked = F.regexp_extract(text, r"(?i)doi\.org/(.+)$", 1)
    return _empty_is_null(F.rtrim(F.regexp_extract(F.when(linked != "", F.trim(linked)).otherwise(text), DOI, 1), F.lit(".,;)")))


def doi_key(value: Column) -> Column:
    """A DOI for comparison: lower case, no resolver, no closing marks; its shape is not checked."""
    return F.rtrim(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"^(https?://(dx\.)?doi\.org/|doi:)", ""), F.lit(".,; "))


def is_preprint_doi(value: Column) -> Column:
    return doi_key(value).startswith("10.48550/arxiv.")


def venue_of(url: Column) -> Column:
    """Key of the journal without DOIs that a link leads to, or null."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^https?://([^/?#]+)", 1))
    path = F.lower(F.regexp_extract(F.trim(url), r"^https?://[^/?#]+([^?#]*)", 1))
    found = F.lit(None).cast("string")
    for key, hosts, prefixes, _ in reversed(VENUES):
        starts = F.lit(False)
        for prefix in prefixes:
            starts = starts | path.startswith(prefix)
        found = F.when(host.isin(hosts) & starts, key).otherwise(found)
    return found


def publication(value: Column) -> Column:
    """struct(kind, doi, url, venue, status, doi_status) of an editor's input: a DOI, a known venue's link or another link.

    kind is null where the input is neither.
    """
    raw = F.trim(value)
    whole = F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), raw).when(raw != "", F.concat(F.lit("https://"), raw))

    def by_link(doi):
        return _let(F.when(doi.isNull() & whole.rlike("^https?://[^/?#]+"), whole), lambda url: _let(venue_of(url), lambda venue: result(doi, url, venue)))

    def result(doi, url, venue):
        kind = F.when(doi.isNotNull(), "doi").when(venue.isNotNull(), "known_no_doi").when(url.isNotNull(), "publication_url")
        status = F.when(doi.isNull() & venue.isNotNull(), "known_no_doi").when(doi.isNotNull() | url.isNotNull(), "published")
        checked = F.when(doi.isNotNull(), "verified").when(venue.isNotNull(), "skipped")
        return F.struct(kind.alias("kind"), doi.alias("doi"), url.alias("url"), venue.alias("venue"), status.alias("status"), checked.alias("doi_status"))

    return _let(doi_in(raw), by_link)
