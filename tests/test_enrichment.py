import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.operators import evidence
from folioscope.plans import enrichment

SF = "/root/testdata/sf0.001"
NAMES = ["before", "queued", "doi", "score", "doi2", "score2", "repository"]
KIND = "before string, queued string, doi string, score double, doi2 string, score2 double, repository boolean"


@pytest.mark.parametrize("name", list(enrichment.registry.queries))
def test_rows_equal_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(enrichment.registry.sql[name])
    columns = [c[0] for c in expected.description]
    wanted = expected.fetchall()
    got = enrichment.registry.queries[name](spark, SF)
    assert wanted and sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(wanted)


def decided(spark, rows, decision):
    return [r[0] for r in spark.createDataFrame(rows, KIND).select(decision).collect()]


def test_replacement(spark):
    r = "replacement_confirmed"
    rows = [
        (r, "a", "a", 0.85, None, None, None), (r, "a", "b", 0.99, "a", 0.99, False), (r, "a", None, None, None, None, None), (r, "a", None, None, "a", 0.9, True),
        (r, "a", None, None, "a", 0.9, None), (r, "a", None, None, "a", 0.84, False), ("other", "a", "a", 1.0, None, None, None), (r, "a", "a", None, None, None, None),
    ]
    got = decided(spark, rows, evidence.replacement(*(F.col(c) for c in NAMES)))
    mismatch = "review_replacement_crossref_mismatch"
    assert got == ["approve_replacement", mismatch, "review_replacement_no_resolver_metadata", "review_replacement_repository", "approve_replacement", "review_replacement_resolver_mismatch", "other", mismatch]


def test_metadata_and_weak_links(spark):
    m, w = "metadata_exact", "review_exact_weak_metadata"
    rows = [(b, "a", doi, score, None, cover, None) for b, doi, score, cover in [(m, "a", 0.95, 0.0), (m, "a", 0.94, 0.0), (m, None, None, None), (w, "a", 0.45, 0.8), (w, "a", 0.45, 0.79), (w, "b", 1.0, 1.0), (w, None, None, None), ("x", "a", 1.0, 1.0)]]
    both = evidence.exact_external(evidence.metadata(*(F.col(c) for c in NAMES[:4])), F.col("queued"), F.col("doi"), F.col("score"), F.col("score2"))
    weak = "review_exact_live_metadata_mismatch"
    assert decided(spark, rows, both) == ["approve_metadata_exact", "review_metadata_crossref_mismatch", "review_metadata_no_crossref", "approve_exact_external", weak, weak, "review_exact_no_live_metadata", "x"]


def test_reference(spark):
    rows = [
        ("Adv. Math. 12 (2019), e123-e140", ["2018", "2019"], ["12"], ["E123--E140"], ["Adv. Math.", "Advances in Mathematics"]),
        ("Discrete Math 112 2020", ["2020"], ["12"], ["7"], ["The Discrete Math"]),
        (None, ["2020"], None, None, None), ("", [], [], [""], [None]), ("Séries of x 3.14", [], [], ["314"], ["Series x"]),
    ]
    t = spark.createDataFrame(rows, "r string, y array<string>, v array<string>, p array<string>, c array<string>")
    got = [tuple(r) for r in t.select(evidence.reference_evidence(*(F.col(c) for c in "ryvpc")).alias("e")).select("e.*").collect()]
    assert got == [(True, True, True, True, 1.0), (True, False, False, True, 1.0), (False, False, False, False, 0.0), (False, False, False, False, 0.0), (False, False, True, True, 1.0)]


def test_journal_overrules(spark):
    t = spark.createDataFrame([("Journal of Integer Sequences 3", True), ("Adv. Math.", False), ("Adv. Math.", True), (None, True)], "r string, ok boolean")
    j = evidence.journal(F.lit("before"), F.col("r"), F.lit(False), F.lit(True), F.col("ok"), F.lit(0.45), F.lit(0.8))
    assert [r[0] for r in t.select(j).collect()] == ["skip_known_doi_less", "before", "approve_journal_reference", "before"]
    scores = spark.range(1).select(evidence.journal_confidence(F.lit(0.8), F.lit(1.0)), evidence.external_confidence(F.lit(0.2), F.lit(0.3), F.lit(0.5), F.lit(0.8))).first()
    assert tuple(scores) == (0.9, 0.65)


def test_repository(spark):
    t = spark.createDataFrame([("An Institutional Repository", None, None), (None, "J", "https://x.org/handle/1"), (None, None, None)], "p string, c string, u string")
    assert [r[0] for r in t.select(evidence.is_repository(*(F.col(c) for c in "pcu"))).collect()] == [True, True, False]


def test_records_are_read_before_the_join(spark, capsys):
    enrichment.reference_reading(spark, "/root/testdata/sf0.001").explain(extended=True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    above, below = plan.split("Join Inner", 1)
    assert "The J. of" in below and "The J. of" not in above
    text = spark.createDataFrame([("pp. a12.5b7 abc x9, Straße A", "É Ünï-x")], "a string, b string").select(evidence.locators(F.col("a")).alias("a"), evidence.plain_words(F.col("b")).alias("b")).first()
    assert text.a == ["a125", "b7", "x9"] and text.b == " e uni x "
