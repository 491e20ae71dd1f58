"""The stages of the corpus pipeline, each against a brute-force version on its own input."""

import re

import corpus_pipeline
from folioscope.llm.packing import CAPACITY
from folioscope.llm.storage import store
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_personal import PATTERNS, valid
from tests.llm.test_substring import brute as cut

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(store(stage(spark, tables[-1], SF_DIR), name))
    first, known, single, kept, masked, packed = ({r.doc_id: r for r in t.collect()} for t in tables)
    assert all(t.columns == columns for t in tables[1:5])

    assert set(known) <= set(first)
    assert len(known) >= 0.98 * len(first)
    assert not [i for i in set(first) - set(known) if first[i].lang is None and re.search("[a-z]", first[i].text or "")]

    expected = groups([(i, r.text) for i, r in known.items()], 5, 80)
    assert set(single) == {i for i, _, component in expected if i == component}

    for doc, n, gone, text in cut([(i, r.text) for i, r in single.items()], 50):
        assert (doc in kept) == (gone == 0 or gone < n)
        if doc in kept:
            assert kept[doc].text == (single[doc].text if gone == 0 else text)

    for i, row in kept.items():
        text = row.text or ""
        spans = sorted((m.start(), m.end(), k) for k in PATTERNS for m in re.finditer(PATTERNS[k], text) if valid(k, m.group()))
        for a, b, k in reversed(spans):
            text = text[:a] + f"[{k.upper()}]" + text[b:]
        assert masked[i].text == text

    assert set(packed) == set(masked)
    loads = tables[5].groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in loads) <= CAPACITY


def test_entry_lists_the_pipeline():
    import __spark_entry__

    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {re.match(r"op\d+_|pipeline|", q).group() for q in __spark_entry__.queries()}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
