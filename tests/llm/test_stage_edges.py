"""Every pipeline stage on empty tables, nulls, repeats, ties and clashing columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

KIND = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = {"score": "1", "lang_pred": "'x'", "ambiguous": "true", "component_id": "7", "n_words": "1", "n_removed": "2", "_cuts": "3", "spans": "'s'", "_found": "4", "rank": "5", "ids": "6", "copies": "8", "start": "9"}


def rows():
    words = "the of and to in is that it was for on with as at by this from".split()
    line = lambda k: " ".join(words[(i * k + i * i) % len(words)] for i in range(120))
    docs = [(i, line(i), "en", "s", 1) for i in range(1, 9)]
    docs += [(20, line(3), "en", "s", 1), (20, line(3), "en", "s", 1), (3, line(3), "en", "s", 1)]  # copies, ties and repeats
    docs += [(30, None, "en", None, None), (31, "", None, "s", 0), (None, "no id, mail a.b@example.com", None, None, 5), (None, None, None, None, None), (32, "123 !!", "en", "s", 1), (33, "x", None, None, None)]
    return docs + [(40, "the " * 30_000 + "a.b@example.com", "en", "s", 1)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_edges(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(rows(), KIND).repartition(3)
    last = name == corpus_pipeline.STAGES[-1][0]
    plain = stage(spark, docs, "")
    got = sorted(map(tuple, plain.collect()), key=repr)
    more = docs.select("*", *(F.expr(v).alias(c) for c, v in CLASHING.items()))
    clashing = stage(spark, more, "")
    assert last or clashing.columns == more.columns
    again = sorted(map(tuple, clashing.select(*plain.columns).collect()), key=repr)
    if last:  # places in sequences are any
        keep = [plain.columns.index(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        got, again = (sorted((tuple(r[i] for i in keep) for r in x), key=repr) for x in (got, again))
    assert got == again
    assert stage(spark, docs.where(F.lit(False)), "").count() == 0
    ids = [r[0] for r in got]
    texts = {} if last else {(r[0], r[1]) for r in got}
    if name == "language_id":
        assert 30 not in ids and 31 not in ids and 32 not in ids and {1, 20, 3, 33, 40} <= set(ids) and ids.count(20) == 2
    if name == "jaccard_join":
        assert 20 not in ids and ids.count(3) == 2 and ids.count(None) == 2 and {30, 31, 32, 33, 40} <= set(ids)
    if name == "substring_dedup":
        assert 20 not in ids and ids.count(3) == 2 and (30, None) in texts and (31, "") in texts and ids.count(None) == 2
    if name == "pii":
        assert len(got) == len(rows()) and (None, "no id, mail [EMAIL]") in texts and (30, None) in texts and any(t.endswith(" [EMAIL]") for i, t in texts if i == 40)
    if last:
        assert ids.count(30) == ids.count(31) == 1 and ids.count(20) == 2 and ids.count(40) > 1
