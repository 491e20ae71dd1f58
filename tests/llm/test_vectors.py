"""Vector searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import nra_topk
from folioscope.llm.hilbert_ann import nearest_neighbours
from folioscope.llm.nra_topk import SortedLists, top_inner_products
from folioscope.llm.vector_queries import op5_hilbert_ann

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, n, dims, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    data = (centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dims))).astype(np.float32)
    data[n // 2 :: 7] = data[3]  # copies of one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(10_000, None), (10_001, [float("nan")] * dims), (10_002, [None] * dims), (None, rows[0][1]), (10_003, [float("inf")] + [0.0] * (dims - 1))]
    return data.astype(np.float64), spark.createDataFrame([(*r, "x") for r in rows + odd], SCHEMA + ", rank string").repartition(5)


def test_top_inner_products(spark):
    data, df = table(spark, 700, 16)
    q = np.floor(256 * data).astype(np.int64)
    got = {(r.query_id, r.rank): (r.id, r.score) for r in top_inner_products(df, F.col("vec_id") % 50 == 0, "vec_id", "embedding").collect()}
    expected = {}
    for i in range(0, 700, 50):
        scores = q @ q[i]
        order = [j for j in np.lexsort((np.arange(700), -scores)) if j != i][:5]
        expected |= {(i, n + 1): (int(j), int(scores[j])) for n, j in enumerate(order)}
    assert got == expected


def brute(data, every, k):
    q = np.floor(256 * data).astype(np.int64)
    out = set()
    for i in range(0, len(data), every):
        scores = q @ q[i]
        order = [j for j in np.lexsort((np.arange(len(data)), -scores)) if j != i][:k]
        out |= {(i, n + 1, int(j), int(scores[j])) for n, j in enumerate(order)}
    return out


def test_blocks_share_bars(spark, monkeypatch):
    monkeypatch.setattr(nra_topk, "BLOCK_ROWS", 150)
    data, df = table(spark, 700, 16)
    got = top_inner_products(df, F.col("vec_id") % 50 == 0, "vec_id", "embedding").collect()
    assert {(r.query_id, r.rank, r.id, r.score) for r in got} == brute(data, 50, 5)


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(2)
    data = np.floor(256 * rng.normal(size=(2000, 8))).astype(np.int64)
    queries = data[:40]
    lists = SortedLists(data)
    left = lists.survivors(queries, 6)
    assert lists.entries < 0.8 * 40 * data.size
    bars = np.array([np.sort(data @ q)[-6] for q in queries], dtype=np.float64)
    barred = SortedLists(data)
    fewer = barred.survivors(queries, 6, bars)
    assert barred.entries < lists.entries
    for q, rows, short in zip(queries, left, fewer, strict=True):
        assert set(np.argsort(data @ q)[-6:]) <= set(rows)
        assert set(np.flatnonzero(data @ q >= np.sort(data @ q)[-6])) <= set(short)


def test_queries_on_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    data = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in rows if r.embedding is not None and np.isfinite(np.array(r.embedding, dtype=np.float64)).all()}
    ids, matrix = np.array(sorted(data)), np.array([data[i] for i in sorted(data)])
    got = op5_hilbert_ann(spark, "/root/testdata/sf0.01").collect()
    hits = total = 0
    for i in ids[ids % 100 == 0]:
        distance = np.sqrt(((matrix - data[i]) ** 2).sum(axis=1))
        best = [int(j) for j in ids[np.lexsort((ids, distance))] if j != i][:10]
        hits, total = hits + len(set(best) & {r.vec_id for r in got if r.query_id == i}), total + 10
    assert hits / total >= 0.9


def test_nearest_neighbours(spark):
    data, df = table(spark, 1500, 16)
    got = nearest_neighbours(df, F.col("vec_id") % 100 == 0, "vec_id", "embedding").collect()
    hits = 0
    for i in range(0, 1500, 100):
        distance = np.sqrt(((data - data[i]) ** 2).sum(axis=1))
        order = [int(j) for j in np.lexsort((np.arange(1500), distance)) if j != i][:10]
        own = sorted((r.rank, r.id, r.score) for r in got if r.query_id == i)
        assert [r[0] for r in own] == list(range(1, 11))
        assert all(abs(score - distance[j]) < 1e-12 for _, j, score in own)
        hits += len({j for _, j, _ in own} & set(order))
    assert hits / 150 >= 0.9


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], SCHEMA)
    assert [(r.query_id, r.id) for r in nearest_neighbours(few, F.col("vec_id") == 0, "vec_id", "embedding").collect()] == [(0, 1)]
    assert sorted((r.rank, r.id, r.score) for r in top_inner_products(few, F.col("vec_id") == 0, "vec_id", "embedding").collect()) == [(1, 1, 0), (2, 2, 0)]
    none = few.where("vec_id > 5")
    assert nearest_neighbours(none, F.lit(True), "vec_id", "embedding").count() == 0
    assert top_inner_products(none, F.lit(True), "vec_id", "embedding").count() == 0
