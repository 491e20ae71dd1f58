"""Phrases from stored postings against a scan of all documents."""

import random

from pyspark.sql import functions as F

from folioscope.operators.lists import decide
from folioscope.operators.postings import PLACED, Postings, _placed, retag


def scan(docs, phrase):
    words = phrase.split()
    times = {i: sum(own[k : k + len(words)] == words for k in range(len(own))) for i, own in docs.items() if i is not None and own}
    return {i: n for i, n in times.items() if n}


def test_batches_against_a_scan(spark, scratch):
    r = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    text = lambda: [r.choice(words) for _ in range(r.randrange(0, 40))]
    index, now = Postings(spark, f"file://{scratch}/index", buckets=16), {}
    assert index.phrase("w1 w2").count() == 0
    frame = lambda docs: spark.createDataFrame(list(docs.items()), "id long, words array<string>")
    for batch in (1, 3, 5):
        gone = r.sample(sorted(now), len(now) // 3)
        if gone:
            index.take_away(spark.createDataFrame([(i,) for i in gone], "id long"), batch - 1)
        back = gone[: len(gone) // 2]
        now = {i: own for i, own in now.items() if i not in gone}
        fresh = {i: text() for i in [*back, *range(100 * batch, 100 * batch + 60)]} | {None: ["w1"], 9000 + batch: None, 9100 + batch: ["", "w1", "w2"]}
        index.add(frame(fresh), batch)
        now |= {i: own for i, own in fresh.items() if i is not None}
        for phrase in ("w1", "w1 w2", "w3 w3", "w1 w2 w1", "w5  w6 w7", "absent w1", ""):
            got = {x.id: x.times for x in index.phrase(phrase).collect()}
            assert got == (scan({i: own for i, own in now.items()}, phrase) if phrase else {}), (batch, phrase)


def test_postings_are_made_before_any_shuffle(spark, scratch):
    """Places of each row's words, without nulls and empty words; an id in two rows of a batch is one posting when it is read."""
    docs = spark.createDataFrame([(1, ["b", "a", "b", None, "", "é"]), (2, None), (3, []), (4, ["", None]), (1, ["a", "c"])], "id long, words array<string>").coalesce(1)
    made = docs.mapInArrow(_placed, PLACED)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().replace("Coalesce", "")
    assert sorted((r.word, r.id, r.places) for r in made.collect()) == [("a", 1, [0]), ("a", 1, [1]), ("b", 1, [0, 2]), ("c", 1, [1]), ("é", 1, [5])]
    index = Postings(spark, f"file://{scratch}/index", buckets=4)
    index.add(docs, 1)
    assert [(r.word, r.id, r.places) for r in index.of(["a"]).collect()] == [("a", 1, [0, 1])]


def test_only_the_phrase_s_buckets_are_read(spark, scratch):
    index = Postings(spark, f"file://{scratch}/index", buckets=64)
    index.add(spark.range(500).select("id", F.array(F.lit("graph"), F.lit("theory"), *(F.concat(F.lit(f"w{k}x"), F.col("id") % 97) for k in range(20))).alias("words")), 1)
    total = spark.read.parquet(f"file://{scratch}/index/postings").count()
    files = {f for f in index.of(["graph", "theory"]).inputFiles() if "/postings/" in f}
    read = spark.read.parquet(*sorted(files)).count()
    assert 1000 <= read < 1000 + total / 16, (read, total)
    assert index.phrase("graph theory").count() == 500 and index.phrase("theory graph").count() == 0


def test_retag_keeps_other_sources(spark):
    links = spark.createDataFrame([(1, 3, "A"), (2, 3, "N"), (3, 3, "A"), (1, 4, "A")], "id long, keyword_id int, source string")
    hits = spark.createDataFrame([(2,), (3,), (5,), (5,)], "id long")
    assert sorted(map(tuple, retag(links, 3, hits).collect())) == [(1, 4, "A"), (2, 3, "N"), (3, 3, "A"), (5, 3, "A")]


def test_one_row_for_names_in_two_cases(spark):
    lists = spark.createDataFrame([(1, "View", False), (1, "VIEW", False)], "user_id long, list_name string, is_starred boolean")
    asked = spark.createDataFrame([(1, 1, "delete", "view", None)], "user_id long, request_id long, action string, list_name string, new_name string")
    assert [r.outcome for r in decide(lists, asked).collect()] == ["deleted"]
