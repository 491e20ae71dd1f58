"""What is shown and searched for: names for display, cleaned titles, terms of a query, values of stored state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.matching import SUFFIXES

#: Entities that are resolved, the ampersand last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
#: Blanks of a registry's title that go, in order.
TITLE_RULES = [
    (r"\s+", " "),
    (r"([(\[{])\s+", "$1"),
    (r"\s+([)\]}])", "$1"),
    (r"\s+([,;:.!?])", "$1"),
    (r"([)\]}])\s+-\s*", "$1-"),
]
#: Words of a query that name no author.
AUTHOR_STOPWORDS = ["a", "an", "and", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]


def unescaped(text: Column) -> Column:
    """Text with the entities of ENTITIES resolved; others stay as they are."""
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def display_name(name: Column) -> Column:
    """'Last, First' as 'first last' in lower case; a suffix stays behind the surname. Null gives an empty name."""
    plain = F.regexp_replace(unescaped(F.coalesce(name, F.lit(""))), r"[\s\u00a0]+", " ")
    parts = F.filter(F.transform(F.split(F.trim(plain, F.lit(" ,;")), ","), lambda p: F.trim(p)), lambda p: p != "")

    def in_order(p):
        suffixed = F.lower(F.rtrim(F.get(p, F.lit(1)), F.lit("."))).isin(SUFFIXES)
        places = F.when((F.size(p) == 2) & ~suffixed, F.array(F.lit(1), F.lit(0))).when((F.size(p) == 3) & suffixed, F.array(F.lit(2), F.lit(0), F.lit(1)))
        moved = F.array_join(F.transform(places, lambda i: F.get(p, i)), " ")
        return F.coalesce(moved, F.when(F.size(p) == 2, F.array_join(p, " ")), F.array_join(p, ", "))

    return F.lower(F.element_at(F.transform(F.array(parts), in_order), 1))


def author_line(names: Column, limit: int = 3) -> Column:
    """The first names for display, and 'et al.' where there are more; names without letters are left out."""
    shown = F.filter(F.transform(names, display_name), lambda n: n != "")
    more = F.when(F.size(shown) > limit, " et al.").otherwise("")
    return F.concat(F.array_join(F.slice(shown, 1, limit), ", "), more)


def clean_title(title: Column) -> Column:
    """A registry's title without braces, entities and tags, with single blanks and no blank inside brackets or before marks."""
    plain = unescaped(F.regexp_replace(title, r"\{([^{}]*)\}", "$1"))
    plain = F.when(plain.rlike(r"</?[A-Za-z][^>]*>"), F.regexp_replace(plain, "<[^>]+>", "")).otherwise(plain)
    for pattern, by in TITLE_RULES:
        plain = F.regexp_replace(F.trim(plain), pattern, by)
    return plain


def _terms(text: Column, pattern: str, marks: str) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(t, F.lit(marks))), lambda t: F.length(t) >= 2))


def highlight_terms(text: Column, limit: int = 8) -> Column:
    """The first different words of a query that are marked in what it finds."""
    return F.slice(_terms(text, "[a-z0-9][a-z0-9_.-]*", "._-"), 1, limit)


def author_terms(text: Column) -> Column:
    """The different words of a query that may be parts of authors' names, in order."""
    return F.filter(_terms(text, r"[\p{L}\p{N}_'-]+", "'-"), lambda t: ~t.isin(AUTHOR_STOPWORDS))


def merge_doi(value: Column) -> Column:
    """A stored DOI for merging: blanks around it and case don't count, an empty one is null."""
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


def confidence_text(value: Column) -> Column:
    """A confidence with three places; null for what is no number."""
    return value.try_cast("decimal(4,3)").cast("string")
