"""Signed merge plans, identity folds and commits of several tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import identity, merge_plan
from folioscope.operators.snapshots import CommitConflict, Snapshots

STATE = "id long, part string, doi string, note string, extra string"


def state(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], STATE)


def rows(df):
    return sorted(map(tuple, df.select("id", "part", "doi", "note").collect()), key=repr)


SOURCE = [(1, "a", "10.1/x", None), (2, "a", None, "n"), (3, None, "é", ""), (4, "b", None, None)]
TARGET = [(1, "a", None, None), (2, "a", None, "n"), (9, "z", "own", None)]


def test_plan_apply_and_undo(spark):
    source, target = state(spark, SOURCE), state(spark, TARGET)
    plan = merge_plan.make_plan(source, target, ("id", "part"), ("doi", "note"))
    assert sorted((r.action, r.key) for r in plan.actions.collect()) == [("insert", '{"id":3,"part":null}'), ("insert", '{"id":4,"part":"b"}'), ("update", '{"id":1,"part":"a"}')]
    after = merge_plan.apply(plan, target, source)
    assert rows(after) == sorted([*SOURCE, TARGET[2]], key=repr)
    assert rows(merge_plan.apply(merge_plan.inverse(plan), after)) == sorted(TARGET, key=repr)
    again = merge_plan.make_plan(source, after, ("id", "part"), ("doi", "note"))
    assert again.actions.count() == 0 and rows(merge_plan.apply(again, after)) == rows(after)


def test_what_is_refused(spark):
    source, target = state(spark, SOURCE), state(spark, TARGET)
    plan = merge_plan.make_plan(source, target, ("id", "part"), ("doi", "note"))
    changed = state(spark, [(1, "a", "10.1/other", None), *TARGET[1:]])
    with pytest.raises(merge_plan.MergeRefused, match="1 rows"):
        merge_plan.apply(plan, changed)
    with pytest.raises(merge_plan.MergeRefused, match="1 rows"):
        merge_plan.apply(plan, state(spark, [*TARGET, (4, "b", None, None)]))
    with pytest.raises(merge_plan.MergeRefused, match="source"):
        merge_plan.apply(plan, target, state(spark, SOURCE[:3]))
    with pytest.raises(merge_plan.MergeRefused, match="signature"):
        merge_plan.verify(merge_plan.Plan(**{**vars(plan), "actions": plan.actions.where("action = 'insert'")}))
    with pytest.raises(merge_plan.MergeRefused, match="lacks 2"):
        merge_plan.make_plan(source, target, ("id", "part"), ("doi", "note"), insert=False)
    untouched = merge_plan.apply(plan, state(spark, [*TARGET, (50, "new", "n", None)]))  # what came since stays
    assert (50, "new", "n", None) in rows(untouched)


def test_one_way_and_empty(spark):
    source, target = state(spark, SOURCE), state(spark, TARGET)
    plan = merge_plan.make_plan(source, target, ("id", "part"), ("doi", "note"), only=F.col("doi").isNotNull())
    assert rows(merge_plan.apply(plan, target, source)) == sorted([SOURCE[0], TARGET[1], TARGET[2], SOURCE[2]], key=repr)
    none = source.where(F.lit(False))
    assert merge_plan.apply(merge_plan.make_plan(none, none, ("id", "part"), ("doi", "note")), none).count() == 0
    assert merge_plan.digest(source) == merge_plan.digest(source.orderBy(F.desc("id")).repartition(3)) != merge_plan.digest(target)


def tables(spark):
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    named = "id long, base_id string, arxiv_id string, published_date date, updated_date date, created_at date, updated_at date, doi string, doi_status string, doi_confidence double, doi_checked_at date, publication_url string, publication_venue_key string, publication_status string, editor_note string"
    papers = [
        (1, "p", "pv1", day(0), None, day(1), day(9), "10.1/a", "verified", 0.9, day(3), "u", None, "published", None),
        (2, "p", "pv2", day(5), None, day(2), day(4), None, "auto", None, None, "", "k", None, "note"),
        (3, "p", "pv3", day(5), None, day(3), day(5), None, None, 0.1, None, None, None, "arxiv_only", None),
        (4, "q", "qv1", day(1), None, day(1), day(1), None, None, None, None, None, None, None, None),
    ]
    return {
        "papers": spark.createDataFrame(papers, named),
        "tags": spark.createDataFrame([(1, 7, day(2)), (3, 7, day(8)), (2, 8, day(1)), (99, 7, day(1))], "paper_id long, tag_id long, created_at date"),
        "keywords": spark.createDataFrame([(1, 5, "manual"), (3, 5, "auto"), (2, 6, "auto"), (2, 9, "system"), (4, 5, "auto")], "paper_id long, keyword_id long, source string"),
        "candidates": spark.createDataFrame([(1, 1, "d", 0.9, "rejected", day(1)), (2, 3, "d", 0.5, "pending", None), (3, 2, "e", 0.1, "approved", day(2))], "candidate_id long, paper_id long, doi string, confidence double, status string, reviewed_at date"),
        "lists": spark.createDataFrame([(1, "l", "pv1", day(1)), (1, "l", "pv3", day(6)), (1, "m", "pv2", day(2)), (1, "m", "gone", day(2))], "user_id long, list_name string, arxiv_id string, added_at date"),
        "authors": spark.createDataFrame([(1, 10, 1), (3, 11, 1), (4, 10, 1)], "paper_id long, author_id long, author_order int"),
        "categories": spark.createDataFrame([(1, "x"), (3, "y")], "paper_id long, category string"),
    }, day


def test_identity_folds(spark):
    old, day = tables(spark)
    new = {name: sorted(map(tuple, df.collect()), key=repr) for name, df in identity.migrate(old).items()}
    assert new["papers"][0] == (3, "p", "pv3", day(5), None, day(1), day(9), "10.1/a", "verified", 0.1, day(3), "u", "k", "arxiv_only", "note")
    assert new["papers"][1][:3] == (4, "q", "qv1") and len(new["papers"]) == 2
    assert new["tags"] == [(3, 7, day(8)), (3, 8, day(1)), (99, 7, day(1))]
    assert new["keywords"] == [(3, 5, "manual"), (3, 9, "system"), (4, 5, "auto")]
    assert new["candidates"] == [(2, 3, "d", 0.9, "pending", day(1)), (3, 3, "e", 0.1, "approved", day(2))]
    assert new["lists"] == [(1, "l", "pv3", day(6)), (1, "m", "gone", day(2)), (1, "m", "pv3", day(2))]
    assert new["authors"] == [(3, 11, 1), (4, 10, 1)] and new["categories"] == [(3, "y")]
    assert new["stats"] == [(2, day(5), 2)]


def test_a_migration_that_dies_between_two_tables(spark, scratch):
    old, _ = tables(spark)
    store = Snapshots(spark, f"file://{scratch}/archive")
    assert store.version() == 0 and store.commit(old, expected=0) == 1
    new = identity.migrate({name: store.read(name) for name in old})
    broken = {"papers": new["papers"], "tags": new["tags"].withColumn("tag_id", F.raise_error(F.lit("killed")).cast("long")), "lists": new["lists"]}
    with pytest.raises(Exception, match="killed"):
        store.commit(broken, expected=1)
    assert store.version() == 1 and store.read("papers").count() == 4 and store.read("tags").count() == 4
    assert store.commit(new, expected=1) == 2
    assert store.read("papers").count() == 2 and store.read("papers", 1).count() == 4
    with pytest.raises(CommitConflict):
        store.commit(new, expected=1)  # made from an older version
    assert store.roll_back(1, expected=2) == 3 and store.read("papers").count() == 4
    assert "stats" not in store.folders() and "stats" in store.folders(2)


def test_a_claim_whose_manifest_never_came(spark, scratch):
    store = Snapshots(spark, f"file://{scratch}/archive")
    one = spark.range(3)
    store.commit({"t": one}, expected=0)
    path, fs = store._path("claims/2")
    fs.createNewFile(path)
    assert store.version() == 1
    with pytest.raises(CommitConflict):
        store.commit({"t": one}, expected=1)
    store.release(2)
    assert store.commit({"t": spark.range(5)}, expected=1) == 2 and store.read("t").count() == 5
    with pytest.raises(CommitConflict):
        store.release(2)


def test_strongest_state(spark):
    r = random.Random(1)
    table = [(i % 5, r.choice(["auto", "system", None, "odd"])) for i in range(40)] + [(9, None)]
    got = spark.createDataFrame(table, "k int, s string").groupBy("k").agg(identity.strongest(F.col("s"), identity.SOURCES).alias("s")).collect()
    want = {k: next((s for s in ("manual", "system", "auto") if (k, s) in table), None) for k, _ in table}
    assert {x.k: x.s for x in got} == want


def test_states_are_worked_out_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(value):
        read.add(1)
        return value

    state = lambda rows: spark.createDataFrame(rows, "id long, v string").withColumn("v", F.udf(seen)("v"))
    source, target = state([(1, "a"), (2, "b")]), state([(2, "x"), (3, "c"), (4, None)])
    plan = merge_plan.make_plan(source, target, ("id",), ("v",))
    assert read.value == 5
    assert sorted(map(tuple, merge_plan.apply(plan, target).collect()), key=str) == [(1, "a"), (2, "b"), (3, "c"), (4, None)]
    assert read.value == 8


def test_digest_sums(spark):
    import hashlib

    hashes = [hashlib.sha256(f'{{"a":{i}}}'.encode()).hexdigest() for i in range(200)]
    sums = [sum(int(h[16 * i : 16 * i + 15], 16) for h in hashes) for i in range(4)]
    assert merge_plan.digest(spark.range(200).select(F.col("id").alias("a"))) == "-".join(map(str, [200, *sums]))
    assert merge_plan.digest(spark.range(0)) == "0-0-0-0-0"


def test_what_was_dealt_by_paper_is_not_dealt_again(spark, scratch):
    old, _ = tables(spark)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = Snapshots(spark, f"file://{scratch}/archive")
        store.commit(old, expected=0, keys={"papers": "id", "tags": "paper_id", "keywords": "paper_id", "candidates": "paper_id", "authors": "paper_id"})
        new = identity.migrate({name: store.read(name) for name in old})
        dealt = {name: new[name]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for name in ("papers", "tags", "keywords", "candidates", "authors")}
        assert dealt == {"papers": 1, "tags": 1, "keywords": 1, "candidates": 1, "authors": 0}
        plain = identity.migrate(old)
        assert all(sorted(map(tuple, new[name].collect()), key=repr) == sorted(map(tuple, plain[name].collect()), key=repr) for name in new)
        folder = store.folders()["tags"]
        assert spark.read.parquet(folder).count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_papers_without_a_base_have_no_revisions(spark):
    old, day = tables(spark)
    odd = old["papers"].withColumn("base_id", F.nullif("base_id", F.lit("q")))
    assert sorted(map(tuple, identity.kept_rows(odd).collect())) == [(1, 3), (2, 3), (3, 3)]
