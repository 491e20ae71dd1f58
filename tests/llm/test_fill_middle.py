"""Fill-in-the-middle against plain Python."""

import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from folioscope.llm.fill_middle import Cutter, fill_middle, restored

NEW = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]


def brute(text, key, unit="(?s:.)", plain=10, spm=20, seed=1):
    text, key = text or "", "" if key is None else str(key)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    ends = [0] + [m.end() for m in regex.finditer(unit, text)]
    n = len(ends) - 1
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((ends[h[0] % (n + 1)], ends[h[1] % (n + 1)]))
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def rows():
    rng = random.Random(8)
    letters = ["a", "B", " ", "\n", "é", "é", "😀", "<", "P>", "<P", ">", "\r\n", "👩‍👩‍👧"]
    found = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(300)]
    found += [(1000, None), (1001, ""), (1002, "with <M> inside"), (None, "no key"), (1003, "x"), (1004, "<S>"), (1005, "long é " * 300_000)]
    return found + found[5:9] + [(2000, found[3][1]), (5, found[12][1])]


@pytest.mark.parametrize("unit", ["(?s:.)", r"\X", r"\w+\W*"])
def test_against_plain_python(spark, unit):
    table = rows()
    docs = spark.createDataFrame([(*r, "old", "kept") for r in table], "doc_id long, text string, form string, lang string").repartition(3)
    made = fill_middle(docs, unit=unit)
    assert made.columns == ["doc_id", "text", "lang", *NEW]
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, t, *brute(t, i, unit)) for i, t in table), key=key)
    assert all(r.back == (r.text or "") and r.lang == "kept" and r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_own_marks_and_shares(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id, ' (a|b) ', repeat('z', int(id))) AS text")
    marks = ("(a|", "[s]", "*")
    made = fill_middle(docs, marks=marks, plain_percent=0, spm_percent=100, seed=4)
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain"}  # every text holds a mark
    marks = ("(p)", "[s]", "*")
    made = fill_middle(docs, marks=marks, plain_percent=0, spm_percent=100, seed=4)
    assert made.where((F.col("form") != "spm") | (restored(F.col("output"), F.col("form"), marks) != F.col("text"))).count() == 0
    assert fill_middle(docs, plain_percent=100).where("form <> 'plain'").count() == 0


def test_empty_table(spark):
    made = fill_middle(spark.createDataFrame([], "doc_id string, text string"))
    assert made.columns == ["doc_id", "text", *NEW] and made.count() == 0


def test_units_of_one_match_and_more():
    cutter = Cutter("(?s:.)", ("<P>", "<S>", "<M>"), 0, 0, 1)
    for n in (0, 1, 511, 512, 513, 1024, 5000):
        assert list(cutter.ends("y" * n)) == list(range(1, n + 1))
    with pytest.raises(ValueError):
        Cutter("a*", ("<P>", "<S>", "<M>"), 0, 0, 1)
