"""Shapes of nested documents."""

import datetime
import json

from pyspark.sql import functions as F

from folioscope.functions.documents import LABEL_SITE, distinct_by_label, document, host_of, with_targets

TARGET = "struct<label:string,title:string,url:string>"
KIND = (
    "arxiv_id string, base_id string, version int, title string, abstract string, primary_category string, published_date date, updated_date date, created_at timestamp, updated_at timestamp, comment string, journal_ref string, doi string, "
    f"doi_status string, publication_url string, publication_venue_key string, publication_status string, editor_note string, authors array<string>, categories array<string>, keywords array<struct<phrase:string,score:bigint,source:string,url:string,target:{TARGET}>>"
)
UTC = datetime.timezone.utc


def paper(**changed):
    row = dict.fromkeys(part.strip().split()[0] for part in KIND.split("keywords")[0].split(",") if part.strip()) | {"keywords": None}
    return tuple((row | {"arxiv_id": "2608.12345v2", "base_id": "2608.12345", "version": 2, "title": "Schur Functions", "published_date": datetime.date(2026, 8, 1), "created_at": datetime.datetime(2026, 8, 2, 3, 4, 5, tzinfo=UTC)} | changed).values())


def shown(spark, *rows):
    return [json.loads(r.d) for r in spark.createDataFrame(list(rows), KIND).select(F.to_json(document(), {"ignoreNullFields": "false"}).alias("d")).collect()]


def test_document(spark):
    schur = ("schur", "Schur functions", f"{LABEL_SITE}/schur.htm")
    keywords = [("schur functions", 10, "manual", "schur", schur), ("posets", 3, "auto", None, None), ("schur again", 2, "auto", "schur", schur)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            (found,) = shown(spark, paper(authors=["Ada Lovelace"], categories=["math.CO", "math.RT"], keywords=keywords))
            assert found["arxiv_id"] == "2608.12345" and found["versioned_arxiv_id"] == "2608.12345v2" and found["arxiv_version"] == 2
            assert found["ingested_at"] == "2026-08-02T03:04:05Z" and found["changed_at"] is None and found["published_at"] == "2026-08-01"
            assert [t["label"] for t in found["targets"]] == ["schur"] and found["targets"][0]["url"] == f"{LABEL_SITE}/schur.htm"
            assert [k["target"] for k in found["keywords"]] == [dict(zip(("label", "title", "url"), schur, strict=True)), None, dict(zip(("label", "title", "url"), schur, strict=True))]
            assert found["urls"]["pdf"].endswith("/pdf/2608.12345v2") and found["publication"]["doi"] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_identity_of_incomplete_rows(spark):
    old, bare, none = shown(spark, paper(arxiv_id="math/0601001v3", base_id=None, version=None), paper(arxiv_id=None, version=None, base_id="2608.1"), paper(arxiv_id="2608.7", base_id=None, version=None))
    assert (old["arxiv_id"], old["arxiv_version"], old["urls"]["site"].split("/paper/")[1]) == ("math/0601001", 3, "math/0601001")
    assert bare["arxiv_version"] == 1 and bare["authors"] == bare["keywords"] == bare["targets"] == []
    assert (none["arxiv_id"], none["versioned_arxiv_id"], none["arxiv_version"]) == ("2608.7", "2608.7", 1)


def test_targets(spark):
    links = [(1, "p", "schur"), (2, "p", "unknown"), (3, "p", None), (4, "p", f"{LABEL_SITE}/x"), (5, None, "https://www.labels.example.org/y"), (6, "p", "https://evil.org/labels.example.org"), (7, "p", "https://labels.example.org@evil.org/"), (8, "p", "ftp://labels.example.org/"), (9, "p", "bare"), (10, "p", "")]
    labels = [("schur", "/schur.htm", "Schur"), ("bare", None, None)]
    got = {r.id: r.target and tuple(r.target) for r in with_targets(spark.createDataFrame(links, "id int, phrase string, url string"), spark.createDataFrame(labels, "label string, href string, title string")).collect()}
    assert got == {
        1: ("schur", "Schur", f"{LABEL_SITE}/schur.htm"), 2: None, 3: None, 4: (f"{LABEL_SITE}/x", "p", f"{LABEL_SITE}/x"), 5: ("https://www.labels.example.org/y",) * 3,
        6: None, 7: None, 8: None, 9: ("bare", "bare", f"{LABEL_SITE}/"), 10: None,
    }
    hosts = spark.createDataFrame([("HTTPS://A.org:80/x",), ("https://u:p@B.org?q",), ("http://[::1]/",), ("x",)], "u string").select(host_of(F.col("u")).alias("h"))
    assert [r.h for r in hosts.collect()] == [None, "b.org", "[::1]", None]


def test_order_of_distinct_targets(spark):
    labels = "b a b c a".split()
    row = spark.createDataFrame([([(x, str(i), "u") for i, x in enumerate(labels)] + [None],)], f"t array<{TARGET}>")
    assert [(t.label, t.title) for t in row.select(distinct_by_label(F.col("t")).alias("d")).first().d] == [("b", "0"), ("a", "1"), ("c", "3")]
