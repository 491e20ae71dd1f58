import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.functions.display import author_line, author_terms, clean_title, confidence_text, display_name, highlight_terms, merge_doi
from folioscope.operators.paging import encode_cursor
from folioscope.plans import editing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(editing.registry.queries))
def test_rows_equal_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "part", "supplier", "customer", "events", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(editing.registry.sql[name])
    columns = [c[0] for c in expected.description]
    wanted = expected.fetchall()
    got = editing.registry.queries[name](spark, SF)
    assert wanted and sorted(got.columns) == sorted(columns)
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(wanted, key=key)


def column(spark, values, of, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(of(F.col("v"))).collect()]


def test_names(spark):
    names = ["Müller, Anna ", "Anna  Müller;", "Smith, Jr.", "Smith, Jr., John", "One, Two, Three", "O&#39;Neil, P.", "", None]
    assert column(spark, names, display_name) == ["anna müller", "anna müller", "smith jr.", "john smith jr.", "one, two, three", "p. o'neil", "", ""]
    lists = [["B, A", "", "D, C"], ["a", "b", "c", "d"], []]
    assert column(spark, lists, author_line, "array<string>") == ["a b, c d", "a, b, c et al.", ""]


def test_titles(spark):
    titles = ["{A} <i>q</i> -analog ( of x ) , [ y ] - z", "x &lt; y &amp; z", "no  markup", "", None]
    assert column(spark, titles, clean_title) == ["A q -analog (of x), [y]-z", "x < y & z", "no markup", "", None]


def test_terms(spark):
    searches = ["The -q-series_ of O'Hara, the Q-SERIES a 7 42", "a b c d1 e2 f3 g4 h5 i6 j7 k8 l9", "", None]
    assert column(spark, searches, highlight_terms) == [["the", "q-series", "of", "hara", "42"], ["d1", "e2", "f3", "g4", "h5", "i6", "j7", "k8"], [], []]
    assert column(spark, searches, author_terms)[0] == ["q-series_", "o'hara", "q-series", "42"]
    assert column(spark, searches, author_terms)[2:] == [[], []]


def test_state_values(spark):
    assert column(spark, [" 10.1/A ", " ", None], merge_doi) == ["10.1/a", None, None]
    assert column(spark, ["0.9", "1", "x", "", None], confidence_text) == ["0.900", "1.000", None, None, None]


def test_pages_follow_each_other(spark):
    """Pages by cursor give every paper of a keyword once, in any order."""
    for order, column_name in (("newest", "published_date"), ("oldest", "published_date")):
        seen, cursor, more = [], None, True
        while more:
            rows = sorted(editing.find_papers(spark, SF, limit=40, order=order, cursor=cursor, published_after="2000-06-01", category="1-URGENT").collect(), key=lambda r: (r[column_name], r["id"]), reverse=order == "newest")
            seen += [r["id"] for r in rows]
            more = bool(rows) and rows[0]["has_more"]
            cursor = encode_cursor(order, rows[-1][column_name], rows[-1]["id"]) if rows else None
        assert len(seen) == len(set(seen)) == editing.papers(spark, SF).where("published_date >= DATE '2000-06-01' AND category = '1-URGENT'").count()


def test_keyword_filter_and_refusals(spark):
    phrase = editing.keywords(spark, SF).where("active").orderBy("keyword_id").first()["phrase"]
    held = editing.paper_keywords(spark, SF).join(editing.keywords(spark, SF).where(F.col("active") & (F.col("phrase") == phrase)), "keyword_id").select("paper_id").distinct().count()
    assert editing.find_papers(spark, SF, limit=500, keyword=phrase).count() == min(held, 500)
    with pytest.raises(ValueError):
        editing.find_papers(spark, SF, order="fastest")
    with pytest.raises(ValueError):
        editing.find_papers(spark, SF, cursor=encode_cursor("oldest", "2001-01-01", 5))
    with pytest.raises(ValueError):
        editing.find_papers(spark, SF, limit=0)
