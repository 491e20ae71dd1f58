"""Substring dedup against plain Python."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm.fm_index import FMIndex, suffix_array
from folioscope.llm.substring_dedup import remove_repeats


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), ws in zip(rows, words, strict=True):
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), ws in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(ws) - window + 1):
            if doc is not None and first[tuple(ws[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ü,"]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (9, 12, 30, 60)]
    rows = [(0, None), (1, ""), (2, "one"), (None, " ".join(passages[2]))]
    for doc in range(3, 60):
        parts = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))] for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        if rng.random() < 0.3:
            parts.append(["the", "same"] * 12)
        rows.append((doc, rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    rows += [(rows[10][0], rows[10][1]), (100, rows[10][1]), (5, rows[12][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string").repartition(5)
    got = remove_repeats(df, window=8)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()), key=repr) == brute(rows, 8)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    got = remove_repeats(df)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_removed"]
    assert got.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_suffix_array(symbols):
    x = np.array(symbols)
    assert suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize("seed", range(5))
def test_matching_statistics(seed):
    r = np.random.default_rng(seed)
    text = np.concatenate([r.integers(1, 5, 60), [0], r.integers(1, 5, 30), [0]])
    asked = r.integers(1, 6, 50)
    asked[asked == 5] = -1
    held = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    got = FMIndex(text, 5).matching_statistics(asked, np.array([0, 20]), np.array([20, 50]))
    for i in range(50):
        end, n = (20 if i < 20 else 50), 0
        while i + n < end and tuple(asked[i : i + n + 1]) in held:
            n += 1
        assert got[i] == n
