import pytest
from pyspark.sql import functions as F

from folioscope.functions.bibtex import citation_key, entry, protect_capitals, search_key
from folioscope.functions.identifiers import base_and_version, doi_in, doi_key, is_preprint_doi, preprint_id, publication
from folioscope.functions.text import fold_accents, slugify


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("arXiv:2401.12345v2", "2401.12345v2"),
        ("https://arxiv.org/pdf/2401.12345v1.pdf", "2401.12345v1"),
        ("arxiv.org/abs/math/0601001", "math/0601001"),
        ("<https://arxiv.org/abs/2401.12345>.", "2401.12345"),
        ("https://example.org/abs/2401.12345", None),
        ("see 2401.12345, there", "2401.12345"),
        ("", None),
        (None, None),
    ],
)
def test_preprint_id(spark, value, expected):
    assert one(spark, value, preprint_id) == expected


@pytest.mark.parametrize(("value", "expected"), [("2608.12345v3", ("2608.12345", 3)), ("math/0601001v2", ("math/0601001", 2)), ("2608.12345", ("2608.12345", 1)), ("not-an-arxiv-id", (None, None))])
def test_base_and_version(spark, value, expected):
    assert tuple(one(spark, value, base_and_version)) == expected


def test_dois(spark):
    assert one(spark, "https://doi.org/10.1002/jgt.22704", doi_in) == "10.1002/jgt.22704"
    assert one(spark, "no identifier", doi_in) is None
    assert one(spark, "HTTPS://DOI.ORG/10.1000/Example.", doi_key) == "10.1000/example"
    assert one(spark, None, doi_key) == ""
    assert one(spark, "https://doi.org/10.48550/arXiv.2211.02774", is_preprint_doi)


@pytest.mark.parametrize(
    ("value", "kind", "venue", "doi_status"),
    [
        ("https://doi.org/10.1002/jgt.22704", "doi", None, "verified"),
        ("https://cs.uwaterloo.ca/journals/JIS/VOL1/example.html", "known_no_doi", "jis", "skipped"),
        ("https://www.emis.de/journals/SLC/wpapers/s80kratt.html", "known_no_doi", "slc", "skipped"),
        ("https://example.org/paper", "publication_url", None, None),
        ("", None, None, None),
    ],
)
def test_publication(spark, value, kind, venue, doi_status):
    found = one(spark, value, publication)
    assert (found.kind, found.venue, found.doi_status) == (kind, venue, doi_status)


def test_citation_keys(spark):
    row = spark.createDataFrame([(["Christos A. Athanasiadis", "Tanja K. Wagner"], ["Pál Erdős"], [])], "a array<string>, b array<string>, c array<string>")
    keys = row.select(citation_key(F.col("a"), F.lit(2024), True).alias("a"), citation_key(F.col("b"), F.lit(2024), False).alias("b"), citation_key(F.col("c"), F.lit(2024), False).alias("c")).first()
    assert tuple(keys) == ("AthanasiadisWagner2024", "Erdos2024x", "arxiv2024x")
    assert tuple(one(spark, "@article{AthanasiadisWagner2024x,", search_key)) == ("athanasiadiswagner2024x", 2024)
    assert one(spark, "A2024", search_key) is None


def test_rendering(spark):
    assert one(spark, "A new LLT formula", protect_capitals) == "A new {{L}{L}{T}} formula"
    assert one(spark, "k1", lambda k: entry("article", k, [("title", F.lit("T")), ("doi", F.lit(None).cast("string")), ("year", F.lit("2024"))])) == "@article{k1,\n  title = {T},\n  year = {2024}\n}"
    assert one(spark, "  Pér  Alexánder--sson! ", slugify) == "per-alexander-sson"
    assert one(spark, "Erdős ﬁ", fold_accents) == "Erdos fi"
