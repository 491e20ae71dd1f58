import pytest
from pyspark.sql import functions as F

from folioscope.operators.attach import attach, ordered_list
from folioscope.operators.paging import decode_cursor, encode_cursor, keyset_page, offset_page
from folioscope.operators.state import cascade, difference, insert_ignore, newest_version, replace_children, upsert
from folioscope.operators.triage import decision


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keyset_pages_cover_everything_once(spark):
    table = spark.createDataFrame([(i, i // 3) for i in range(10)], "id int, k int")
    keys, seen, at = [("k", True), ("id", True)], [], None
    while True:
        page = keyset_page(table, keys, 4, at).orderBy(F.desc("k"), F.desc("id")).collect()
        seen += [r.id for r in page]
        if not page or not page[0].has_more:
            break
        at = [page[-1].k, page[-1].id]
    assert seen == list(range(9, -1, -1))
    assert [r.id for r in offset_page(table, [F.asc("id")], 2, 3).collect()] == [3, 4, 5]
    with pytest.raises(ValueError, match="limit"):
        keyset_page(table, keys, 0)


def test_cursor():
    cursor = encode_cursor("newest", "2024-01-01", 8)
    assert decode_cursor(cursor, "newest") == ("2024-01-01", 8)
    for bad, order in ((cursor, "changed"), ("%%%", "newest"), (encode_cursor("newest", "x", 0), "newest")):
        with pytest.raises(ValueError, match="cursor"):
            decode_cursor(bad, order)


def test_attach(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "pid int, o int, name string")
    lists = ordered_list(children, "pid", F.col("o"), F.col("name"), "names")
    assert rows(attach(parents, lists, "id", "pid", "names")) == [(1, ["a", "b"]), (2, [])]


def test_state(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "c", "y"), (3, "d", "y"), (3, "e", "y")], "id int, v string, w string")
    assert rows(insert_ignore(old, new, ["id"], [F.col("v")])) == [(1, "a", "x"), (2, "b", "x"), (3, "d", "y")]
    assert rows(upsert(old, new.where("v <> 'e'"), ["id"], ["v"])) == [(1, "a", "x"), (2, "c", "x"), (3, "d", "y")]
    assert rows(difference(old, new.where("v <> 'e'"), "id", ["v"])) == [(1, "extra"), (2, "changed"), (3, "missing")]
    assert rows(newest_version(new, "id", F.col("v"))) == [(2, "c", "y"), (3, "e", "y")]
    assert rows(replace_children(old, new, "id", spark.createDataFrame([(2,)], "id int"))) == [(1, "a", "x"), (2, "c", "y")]
    assert rows(cascade(spark.createDataFrame([(1,)], "gone int"), {"old": (old, "id")})["old"]) == [(2, "b", "x")]


@pytest.mark.parametrize(
    ("linked", "qc", "lc", "stored", "link", "title", "cover", "exact", "expected"),
    [
        (None, False, False, 0.9, 0.0, 0.9, 0.9, True, "metadata_exact"),
        (None, False, False, 0.84, 0.0, 0.8, 0.95, False, "review_high_evidence"),
        ("10.48550/arxiv.1", True, False, 0.99, 0.0, 1.0, 1.0, True, "unresolved"),
        ("10.1/a", True, False, 0.9, 0.9, 1.0, 1.0, True, "review_exact_conflict"),
        ("10.1/a", False, False, 0.2, 0.9, 0.2, 0.2, False, "approve_confirmed"),
        ("10.1/a", False, False, 0.2, 0.3, 0.2, 0.2, False, "review_exact_weak_metadata"),
        ("10.1/b", False, False, 0.2, 0.9, 0.2, 0.2, False, "replacement_confirmed"),
        ("10.1/b", False, True, 0.2, 0.9, 0.2, 0.2, False, "review_replacement_conflict"),
        ("10.1/b", False, False, 0.9, 0.2, 0.2, 0.2, False, "review_disagreement"),
    ],
)
def test_decision(spark, linked, qc, lc, stored, link, title, cover, exact, expected):
    values = [F.lit(x) for x in ("10.1/a", linked, qc, lc, stored, link, title, cover, exact)]
    values[1] = values[1].cast("string")
    assert spark.range(1).select(decision(*values).alias("d")).first().d == expected
