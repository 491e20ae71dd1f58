import os
from datetime import date, datetime

import pytest

from folioscope.sources.feed import FeedSource, feed_query, revisions, windows, windows_to_fetch
from folioscope.streaming.ingest import VersionedTable, ingest


def entry(base, version, day, more=""):
    return f'<entry><id>http://arxiv.org/abs/{base}v{version}</id><title>On\n  {base}</title><published>{day}T01:00:00Z</published><updated>{day}T03:00:00+02:00</updated><author><name>Ann  B</name></author>{more}<category term="math.CO"/></entry>'


def land(path, kind, first, last, pages, complete=True):
    folder = f"{path}/{kind}/{first}-{last}"
    os.makedirs(folder, exist_ok=True)
    for n, entries in enumerate(pages):
        with open(f"{folder}/page-{n:04}.xml", "w") as f:
            f.write('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">' + "".join(entries) + "</feed>")
    if complete:
        open(f"{folder}/complete", "w").close()


@pytest.fixture
def feed(spark, scratch):
    spark.dataSource.register(FeedSource)
    land(scratch, "submitted", "20240101", "20240102", [[entry("2401.00001", 1, "2024-01-01"), entry("2401.00002", 1, "2024-01-02")], [entry("2401.00003", 1, "2024-01-02", '<arxiv:doi>10.1000/x</arxiv:doi><arxiv:primary_category term="math.PR"/>')]])
    land(scratch, "submitted", "20240102", "20240103", [[entry("2401.00002", 1, "2024-01-02")]])
    land(scratch, "updated", "20240102", "20240103", [[entry("2401.00001", 2, "2024-01-03")]])
    land(scratch, "submitted", "20240103", "20240104", [[entry("2401.00009", 1, "2024-01-04")]], complete=False)
    return scratch


def test_windows_and_queries():
    assert windows(date(2024, 1, 30), date(2024, 2, 3), 2) == [(date(2024, 1, 30), date(2024, 1, 31)), (date(2024, 2, 1), date(2024, 2, 2)), (date(2024, 2, 3), date(2024, 2, 3))]
    assert windows(date(2024, 1, 2), date(2024, 1, 1), 2) == []
    assert feed_query("updated", date(2024, 1, 1), date(2024, 1, 2)) == "cat:math.CO AND lastUpdatedDate:[202401010000 TO 202401022359]"
    with pytest.raises(ValueError):
        windows(date(2024, 1, 1), date(2024, 1, 2), 0)


def test_batch_read(spark, feed):
    read = spark.read.format("landed_feed").option("path", feed)
    rows = read.load()
    assert sorted((r.base_id, r.version, r.kind) for r in rows.collect()) == [("2401.00001", 1, "submitted"), ("2401.00001", 2, "updated"), ("2401.00002", 1, "submitted"), ("2401.00002", 1, "submitted"), ("2401.00003", 1, "submitted")]
    assert rows.rdd.getNumPartitions() == 3
    row = rows.where("base_id = '2401.00003'").first()
    assert (row.title, row.doi, row.primary_category, row.categories, row.authors, row.summary) == ("On 2401.00003", "10.1000/x", "math.PR", ["math.CO"], ["Ann B"], None)
    assert row.published == datetime(2024, 1, 2, 1) and row.updated == datetime(2024, 1, 2, 1)
    assert revisions(rows).count() == 4
    assert {r.kind for r in read.option("start", "2024-01-03").load().collect()} == {"submitted", "updated"}
    assert read.option("end", "2023-12-31").load().isEmpty()
    left = windows_to_fetch(spark, feed, date(2024, 1, 1), date(2024, 1, 4), 2)
    assert sorted((r.kind, r["first"].day) for r in left.collect()) == [("submitted", 3), ("updated", 1), ("updated", 3)]


def test_caps_fail_or_stop(spark, feed):
    read = spark.read.format("landed_feed").option("path", feed).option("max_results", 2)
    with pytest.raises(Exception, match="more than 2 entries"):
        read.load().count()
    assert read.option("on_cap", "stop").load().count() == 4


def test_odd_pages(spark, scratch):
    spark.dataSource.register(FeedSource)
    land(scratch, "submitted", "20240101", "20240101", [[], ["<entry><id>http://arxiv.org/abs/math/0101001</id><published>soon</published></entry><entry/>"]])
    rows = sorted(((r.base_id or "", r.version, r.published, r.authors) for r in spark.read.format("landed_feed").option("path", scratch).load().collect()))
    assert rows == [("", None, None, []), ("math/0101001", 1, None, [])]
    assert spark.read.format("landed_feed").option("path", f"{scratch}/none").load().isEmpty()


def test_stream_takes_each_window_once(spark, feed):
    table, seen = VersionedTable(spark, f"{feed}/state"), f"{feed}/checkpoint"

    def poll():
        stream = spark.readStream.format("landed_feed").option("path", feed).load()
        query = ingest(stream.select("base_id", "version", "updated", "title"), table, seen)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress), sorted((r.base_id, r.version) for r in table.read().collect())

    assert poll() == (5, [("2401.00001", 2), ("2401.00002", 1), ("2401.00003", 1)])
    assert poll()[0] == 0
    land(feed, "submitted", "20240103", "20240104", [[entry("2401.00009", 1, "2024-01-04"), entry("2401.00001", 1, "2024-01-01")]])
    assert poll() == (2, [("2401.00001", 2), ("2401.00002", 1), ("2401.00003", 1), ("2401.00009", 1)])
