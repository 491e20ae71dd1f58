from datetime import datetime

from pyspark.sql import functions as F

from folioscope.sources.records import missing_keys, read_atom, read_bibliography, read_candidates, read_registry, write_candidates
from folioscope.streaming.ingest import VersionedTable, deduplicated, ingest


def test_files(spark, scratch):
    with open(f"{scratch}/feed.xml", "w") as f:
        f.write('<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A\n  title</title><author><name>Ann B</name></author><author><name>Cy D</name></author><category term="math.CO"/></entry></feed>')
    row = read_atom(spark, f"{scratch}/feed.xml").first()
    assert (row.title, row.authors, row.categories) == ("A title", ["Ann B", "Cy D"], ["math.CO"])
    with open(f"{scratch}/works.json", "w") as f:
        f.write('{"DOI":"10.1/X","title":["T","U"],"author":[{"family":"B","given":"A"},{"name":"Group"}],"container-title":["J"],"issued":{"date-parts":[[2024,5]]}}\n')
    row = read_registry(spark, f"{scratch}/works.json").first()
    assert (row.doi, row.title, row.authors, row.container, row.year) == ("10.1/x", "T U", ["B, A", "Group"], "J", 2024)
    with open(f"{scratch}/refs.bib", "w") as f:
        f.write("@article{a,\n  Eprint = {2401.00001v3},\n  DOI = {10.1/x}\n}\n@book{b,\n  DOI={10.2/y}\n}\n")
    assert [tuple(r) for r in read_bibliography(spark, f"{scratch}/refs.bib").collect()] == [("2401.00001", "10.1/x")]
    write_candidates(spark.createDataFrame([("random tree", 7)], "phrase string, paper_count int"), f"{scratch}/csv")
    assert [tuple(r) for r in read_candidates(spark, f"{scratch}/csv").collect()] == [("random tree", 7, 2)]
    ids = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert [r.k for r in missing_keys(ids, spark.createDataFrame([(1,)], "k int"), "k").collect()] == [2]


def test_ingest_is_idempotent(spark, scratch):
    schema = "base_id string, version int, updated timestamp, title string"

    def land(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{scratch}/in/{name}")

    land("a", [("p", 2, datetime(2024, 1, 2), "second"), ("q", 1, datetime(2024, 1, 1), "only")])
    land("b", [("p", 1, datetime(2024, 1, 1), "first"), ("p", 2, datetime(2024, 1, 2), "second")])
    table = VersionedTable(spark, f"{scratch}/state")
    for _ in range(2):
        stream = deduplicated(spark.readStream.schema(schema).parquet(f"{scratch}/in/*"))
        ingest(stream, table, f"{scratch}/checkpoint").awaitTermination()
    assert sorted((r.base_id, r.version, r.title) for r in table.read().collect()) == [("p", 2, "second"), ("q", 1, "only")]
    table.merge(spark.createDataFrame([("p", 1, datetime(2024, 1, 3), "late")], schema), 1000)
    assert table.read().where(F.col("base_id") == "p").first().title == "second"
