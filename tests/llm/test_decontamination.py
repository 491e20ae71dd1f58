"""Benchmark passages and the phrase index against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm.decontamination import find_benchmark_passages, remove_benchmark_passages
from folioscope.llm.phrase_index import PhraseIndex, lane_suffixes, lanes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOWER))]


def brute(docs, items, window):
    phrases = {}
    for item, text in items:
        own = [w for w, _, _ in words_of(text)]
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if own else 0):
            phrases.setdefault(tuple(own[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, found = words_of(text), set(), set()
        plain = [w for w, _, _ in own]
        for k in {len(p) for p in phrases}:
            for i in range(len(plain) - k + 1):
                held = phrases.get(tuple(plain[i : i + k]))
                if held is not None:
                    hit.update(range(i, i + k))
                    found |= held - {None}
        spans = []
        for i in sorted(hit):
            if spans and i - 1 in hit:
                spans[-1] = (spans[-1][0], own[i][2])
            else:
                spans.append((own[i][1], own[i][2]))
        out.append((doc, len(own), len(hit), spans, sorted(found)))
    return sorted(out, key=repr)


def tables():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "naïve", "x9", "Zeta"]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, rng.choice([" ", ", ", "-"]).join(line(rng.randrange(1, 20)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "!!"), (None, " ".join(line(9))), (3, " ".join(line(8))), (33, items[4][1]), (34, items[4][1].upper())]
    docs = [(0, None), (1, ""), (2, "--")]
    for doc in range(3, 80):
        parts = [line(rng.randrange(0, 30)) + [f"odd{doc}"] for _ in range(3)]
        parts.insert(rng.randrange(4), (items[rng.randrange(len(items))][1] or "").split(" "))
        docs.append((doc, rng.choice([" ", "\n", "… "]).join(w for p in parts for w in p)))
    long = " ".join(line(30_000) + items[6][1].split(" ") + line(9_000))
    return docs + [(200, long), (None, docs[9][1]), (9, docs[9][1]), (9, docs[12][1])], items


@pytest.mark.parametrize(("window", "rows"), [(6, 200_000), (6, 40), (10, 200_000), (1, 200_000)])
def test_against_plain_python(spark, window, rows):
    docs, items = tables()
    if rows == 40:
        docs = docs[:60]
    table = spark.createDataFrame([(*r, "old") for r in docs], "doc_id long, text string, items string").repartition(3)
    benchmark = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, words string")
    got = find_benchmark_passages(table, benchmark, window, phrase_rows=rows).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, [(s.start, s.end) for s in r.spans], r["items"]) for r in got), key=repr) == brute(docs, items, window)


def test_removal_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two THREE four! And this."), (2, None), (3, "one two three four")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three"), (2, "two three four")], "item_id long, text string")
    got = {r.doc_id: r.text for r in remove_benchmark_passages(docs, items, 3).collect()}
    assert got == {1: "Keep this. ! And this.", 2: None, 3: ""}
    assert find_benchmark_passages(docs.where(F.lit(False)), items).count() == 0
    assert find_benchmark_passages(docs, items.where(F.lit(False))).where("n_hit > 0 OR size(items) > 0").count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_index(seed):
    r = np.random.default_rng(seed)
    most = int(r.integers(1, 6))
    first = np.concatenate([[0], np.sort(r.integers(0, 700, 3)), [700]])
    symbols = r.integers(0, 4, 700) * (r.random(700) < 0.97)
    if seed % 2:
        symbols[100:380] = 2  # long runs of one word
        symbols[400:550] = symbols[100:250]
    starts, ends = lanes(symbols, first, 1, most)
    index = PhraseIndex(symbols, starts, ends, 4)
    phrases, lengths = r.integers(1, 4, (40, most)), r.integers(1, most + 1, 40)
    phrases[np.arange(most) >= lengths[:, None]] = 0
    phrase, at = index.occurrences(phrases, lengths)
    got = set(zip(phrase.tolist(), at.tolist(), strict=True))
    inside = lambda a, b: not any(a < f < b for f in first)
    want = {(p, a) for p in range(40) for a in range(700 - lengths[p] + 1) if symbols[a : a + lengths[p]].tolist() == phrases[p, : lengths[p]].tolist() and inside(a, a + lengths[p])}
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_lane_suffixes(seed):
    r = np.random.default_rng(seed)
    parts = [r.integers(1, 1 + 2 ** r.integers(1, 16), r.integers(1, 90)).tolist() for _ in range(6)]
    parts = parts + parts[:3]
    text = np.array([x for p in parts for x in (*p, 0)])
    ends = np.flatnonzero(text == 0)
    # Zeros that grow from left to right, below all words.
    keyed = [x if x else -len(text) + i for i, x in enumerate(text.tolist())]
    want = sorted(range(len(text)), key=lambda i: keyed[i : int(ends[np.searchsorted(ends, i)]) + 1])
    assert lane_suffixes(text).tolist() == want
