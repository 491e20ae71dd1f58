"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm.importance import draw, feature_buckets, importance_weights, resample, suffix_runs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, depth=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, depth + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, least, depth, buckets):
    bucket = lambda g: crc32(g.encode()) % buckets
    own = [(doc, *grams(text, depth)) for doc, text in docs]
    s, t = Counter(bucket(g) for _, _, gs in own for g in gs), Counter(bucket(g) for text in target for g in grams(text, depth)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc, n, gs in own:
        weight = sum(gain[bucket(g)] for g in gs) // max(len(gs), 1)
        h = int(hashlib.sha256(f"7:{doc}".encode()).hexdigest()[:8], 16)
        score = None if doc is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, n, len(gs), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, rows), key=repr)


def tables():
    rng = random.Random(2)
    words = ["the", "The", "naïve", "É", "x1", "of", "set", "graph", "tree", "😀", *(f"w{i}" for i in range(60))]
    text = lambda n: rng.choice([" ", "-", "\n. "]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(250)] + [(300, None), (301, ""), (302, "?!"), (303, text(40_000)), (None, text(50)), (None, text(50))]
    return docs + [(400, docs[7][1]), (401, docs[7][1])], [text(12) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize(("percent", "least", "depth", "buckets"), [(25, 20, 2, 10_000), (60, 1, 3, 97), (0, 5, 1, 10_000)])
def test_against_plain_python(spark, percent, least, depth, buckets):
    docs, target = tables()
    table = spark.createDataFrame([(*r, "old", 3) for r in docs], "doc_id long, text string, weight string, rank int").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = draw(importance_weights(table, wanted, depth, buckets), percent, least)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, percent, least, depth, buckets)


def test_repeated_ids_and_rows(spark):
    docs = spark.range(3).selectExpr("7L AS doc_id", "repeat('a b c d e ', 10) AS text")
    ranks = draw(importance_weights(docs, docs), percent=70).collect()
    assert sorted((r.rank for r in ranks), key=repr) == [1, 2, None]
    assert resample(docs, docs, percent=70).count() == 3


def test_empty_tables(spark):
    docs, target = tables()
    table, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    assert draw(importance_weights(table.where(F.lit(False)), wanted)).count() == 0
    got = draw(importance_weights(table, wanted.where(F.lit(False))))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, [], 25, 20, 2, 10_000)


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    r = np.random.default_rng(seed)
    symbols = np.concatenate([x for _ in range(8) for x in (r.integers(1, 4, r.integers(0, 9)), [0])])
    for n, (at, run, heads) in enumerate(suffix_runs(symbols, 3), 1):
        want = {i: tuple(symbols[i : i + n].tolist()) for i in range(len(symbols) - n + 1) if 0 not in symbols[i : i + n]}
        assert sorted(at.tolist()) == sorted(want)
        named = {k: want[int(heads[k])] for k in range(len(heads))}
        assert len(set(named.values())) == len(named)
        assert all(named[k] == want[i] for i, k in zip(at.tolist(), run.tolist(), strict=True))


def test_buckets_of_one_part():
    texts = ["One two one two", None, "é", "", "a b c"]
    found, ends, n_words = feature_buckets(pa.array(texts), 3, 1000)
    assert n_words.tolist() == [4, 0, 1, 0, 3]
    for text, own in zip(texts, np.split(found, ends[:-1]), strict=True):
        assert sorted(own.tolist()) == sorted(crc32(g.encode()) % 1000 for g in grams(text, 3)[1])
