"""Language ID, URL filters and sharding."""

from pyspark.sql import functions as F

from folioscope.llm.components import connected_components
from folioscope.llm.language_id import codewords, fit, identify
from folioscope.llm.language_queries import op8_output_codes
from folioscope.llm.sharding import SlotMap, first_map, rebalance, shard_records
from folioscope.llm.url_filter import judge_urls

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    got = op8_output_codes(spark, SF_DIR).join(truth, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100
    assert right / n >= 0.95


def test_language_edges(spark):
    rows = [(1, "the tree of the graph", "en"), (2, "der baum und der graph", "de"), (3, None, "en"), (4, "", "en"), (5, "123 ...", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(df, fit(df)).collect()}
    assert (got[1][0], got[2][0]) == ("en", "de")
    assert all(got[i] == ("und", 0.0) for i in (3, 4, 5))
    nothing = fit(df.where(F.lit(False)))
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {"und"}
    code = codewords(9)
    assert min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 8


def test_margins_take_bytes_by_the_text_and_not_by_the_bit():
    """A text of 4 MB is judged as its parts are, in less than 40 bytes of memory for each of its bytes, without a table of bytes by bits."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from folioscope.llm import language_id

    rng = np.random.default_rng(1)
    model = language_id.LanguageModel(list("abcde"), codewords(5), rng.normal(size=(language_id.BUCKETS, 15)).astype(np.float32), np.full((5, 15), 1 / 15))
    short = "the tree of the graph and its leaves "
    texts = pa.array([short * 110_000, "", short, short])
    small = model.margins(pa.array([short]))
    tracemalloc.start()
    found = model.margins(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found[2], small[0]) and np.array_equal(found[3], small[0]) and not found[1].any()
    buckets, _ = language_id.trigram_buckets(texts.slice(0, 1))
    whole = np.bincount(buckets, minlength=language_id.BUCKETS) @ model.weights.astype(np.float64) / len(buckets) * language_id.SCALE
    assert np.allclose(found[0], whole, atol=1e-3)
    assert peak < 40 * len(texts[0].as_py()), peak


def test_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block")]
    rows = [
        (1, "HTTP://Example.ORG/es/x?y", ""), (2, "https://a.org/", ""), (3, "http://x.com/de/1", ""), (4, "http://y.net/1", '<link rel="canonical" href="http://x.com/de/1">'),
        (5, "http://z.net/2", "<meta http-equiv=refresh content='0; url=http://y.net/1'>"), (6, None, None), (7, "/rel", "x"), (8, "http://notexample.org/es/", ""), (9, "http://w.net/", '<link rel=canonical href="http://a.org/">'),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rules).collect()}
    assert got == {
        1: ("example.org", "/es/x", "example.org/es/", "block"), 2: ("a.org", "/", "org/", "allow"), 3: ("x.com", "/de/1", "com/de/", "block"), 4: ("y.net", "/1", None, "block"),
        5: ("z.net", "/2", None, "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("notexample.org", "/es/", "org/", "allow"), 9: ("w.net", "/", None, "allow"),
    }


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (3, 1), *((20 + i, 21 + i) for i in range(40))]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8} | {i: 20 for i in range(20, 61)}


def test_shards(spark):
    df = spark.createDataFrame([(i % 400 if i else None, "é" * (i % 90) if i % 50 else None, "x") for i in range(800)], "doc_id long, text string, shard string").repartition(4)
    rows = shard_records(df, shards=4, slots=256).collect()
    assert len(rows) == 800
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
    assert max(loads) <= 1.05 * min(loads)
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in rows)
    assert shard_records(df.where(F.lit(False)), shards=4, slots=16).count() == 0


def test_rebalance_moves_few_slots(spark):
    sizes = {v: 100 + v % 64 for v in range(1024)}
    old = first_map(sizes, 4, 1024)
    new = rebalance(old, sizes, 5)
    loads = [sum(sizes[v] for v, s in new.items() if s == shard) for shard in range(5)]
    assert max(loads) <= 1.05 * min(loads)
    assert sum(old[v] != new[v] for v in old) <= 1.3 * 1024 / 5
    table = SlotMap(spark)
    table.save(1, old)
    table.save(2, new)
    assert {r.vslot: r.shard for r in table.load(1).collect()} == old
