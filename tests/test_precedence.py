from folioscope.operators.precedence import revised

STORED, LANDED = "id long, version int, doi string, doi_status string, publication_status string", "id long, version int, doi string"


def test_outcomes(spark):
    stored = [
        (1, 1, "10.1017/correct", "verified", "published"), (2, 1, None, None, None), (3, 1, "10.1017/correct", "auto", "published"), (4, 3, "10.1000/a", "auto", None), (5, 1, "10.1000/b", "auto", None),
        (6, 1, "10.1000/C", "verified", None), (7, 1, "10.1000/d", "auto", "published"), (8, 1, "10.1000/e", "auto", None), (10, 2, None, None, "known_no_doi"), (11, 1, "10.1000/f", "auto", None),
    ]
    landed = [(1, 2, "10.1007/unrelated"), (2, 2, "10.1007/Unrelated"), (3, 2, "10.1007/unrelated"), (4, 2, "10.1000/z"), (5, 1, None), (6, 2, "https://doi.org/10.1000/c"), (7, 2, "10.1000/D"), (9, 1, "10.1000/new"), (10, 2, " "), (11, 2, "10.1000/g")]
    rejected = [(2, "10.1007/unrelated"), (2, "10.1007/UNRELATED"), (3, "https://doi.org/10.1007/unrelated"), (7, "10.1000/d"), (8, "10.1000/g"), (None, "10.1000/g"), (11, None)]
    got = revised(spark.createDataFrame(stored, STORED), spark.createDataFrame(landed, LANDED), spark.createDataFrame(rejected, "id long, doi string"))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 2, "kept_verified", "10.1017/correct", "verified", "published"), (2, 2, "rejected_ignored", None, None, None), (3, 2, "rejected_ignored", "10.1017/correct", "auto", "published"),
        (4, 3, "stale", "10.1000/a", "auto", None), (5, 1, "no_doi", "10.1000/b", "auto", "published"), (6, 2, "taken", "10.1000/c", "arxiv", "published"), (7, 2, "rejected_removed", None, None, "published"),
        (8, 1, "untouched", "10.1000/e", "auto", None), (9, 1, "inserted", "10.1000/new", "arxiv", "published"), (10, 2, "no_doi", None, None, "known_no_doi"), (11, 2, "taken", "10.1000/g", "arxiv", "published"),
    ]


def test_nothing_stored_or_landed(spark):
    none, row = spark.createDataFrame([], LANDED), spark.createDataFrame([(1, 1, "10.1000/a")], LANDED)
    assert revised(spark.createDataFrame([], STORED), row, none.select("id", "doi")).first().outcome == "inserted"
    assert revised(spark.createDataFrame([], STORED), none, none.select("id", "doi")).isEmpty()
