"""Atom feeds, registry records, candidate files, bibliographies and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATOM = "id string, title string, summary string, published timestamp, updated timestamp, doi string, journal_ref string, author array<struct<name:string>>, category array<struct<_term:string>>"
CROSSREF = "DOI string, title array<string>, author array<struct<family:string,given:string,name:string>>, `container-title` array<string>, volume string, page string, `article-number` string, issued struct<`date-parts`:array<array<int>>>"
CANDIDATES = "phrase string, paper_count int, word_count int"


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files: (entry_id, title, summary, published, updated, doi, journal_ref, authors, categories).

    Namespace prefixes of extension elements are ignored; malformed entries come as nulls, not as errors.
    """
    raw = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).option("mode", "PERMISSIVE").schema(ATOM).load(path)
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")).alias(c)
    return raw.select(F.col("id").alias("entry_id"), squeezed("title"), squeezed("summary"), "published", "updated", "doi", "journal_ref", F.col("author.name").alias("authors"), F.col("category._term").alias("categories"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Landed registry records, one JSON object in a line: (doi, title, authors, container, volume, page, year)."""
    raw = spark.read.schema(CROSSREF).json(path)
    name = lambda a: F.coalesce(F.nullif(F.concat_ws(", ", a["family"], a["given"]), F.lit("")), a["name"])
    return raw.select(
        F.lower("DOI").alias("doi"), F.array_join("title", " ").alias("title"), F.array_compact(F.transform("author", name)).alias("authors"),
        F.col("container-title")[0].alias("container"), "volume", F.coalesce("page", "article-number").alias("page"), F.col("issued.date-parts")[0][0].alias("year"),
    )


def nearest_year(dates, target):
    """The date part list whose year is nearest to target; dates: array<struct<field_order,parts>>, the first of equals."""
    ordered = F.array_sort(F.transform(dates, lambda d: F.struct(F.abs(d["parts"][0] - target).alias("apart"), d["field_order"], d["parts"])))
    return F.element_at(ordered, 1)["parts"]


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDIDATES).option("header", True).csv(path)


def write_candidates(phrases: DataFrame, path: str) -> None:
    phrases.select("phrase", "paper_count", F.size(F.split("phrase", " ")).alias("word_count")).write.option("header", True).csv(path)


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """(base_id, doi) of the entries of .bib files that name both; versions are cut off."""
    entries = spark.read.option("lineSep", "@").text(path)
    field = lambda name: F.regexp_extract("value", rf'(?im)^\s*{name}\s*=\s*[{{"]([^}}"]+)', 1)
    found = entries.select(F.regexp_replace(F.trim(field("eprint")), r"v[0-9]+$", "").alias("base_id"), F.trim(field("doi")).alias("doi"))
    return found.where("base_id <> '' AND doi <> ''")


def missing_keys(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Keys that have to be fetched."""
    return wanted.select(key).distinct().join(cached.select(key), key, "left_anti")


def write_report(decisions: DataFrame, path: str) -> DataFrame:
    """Decisions as JSON lines; returns their counts."""
    decisions.write.json(path)
    return decisions.groupBy("decision").count()


def write_bibtex(entries: DataFrame, path: str) -> None:
    """Entries (column bibtex) as text, a blank line after each."""
    entries.select(F.concat("bibtex", F.lit("\n")).alias("value")).write.text(path)
