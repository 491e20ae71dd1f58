"""Scores of pairs as columns against plain Python."""

import random

from pyspark.sql import functions as F

from folioscope.functions.matching import title_key
from folioscope.operators.pairing import score_pairs
from tests import plain_matching as plain

GIVEN = ["Jesse", "J.", "J", "Anna Maria", "A. M.", "Anna", "Zhai", "Ö.", "", "Vincent E."]
FAMILY = ["Loth", "Campion Loth", "van der Berg", "Vu", "Ben Av", "Dvořák-Smith", "Smith", "Li", "O'Neil", "Smith Jr."]
WORDS = ["graphs", "coloured", "colored", "on", "the", "$p^{th}$", r"$\alpha$", "trees", "Macdonald", "MacdonaldPolynomial", "polynomial", "II", "—"]


def name(r):
    given, family = r.choice(GIVEN), r.choice(FAMILY)
    return r.choice([f"{given} {family}", f"{family}, {given}", family, given, f"{given} {given} {family}"])


def record(r):
    title = " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 6)))
    return title, [name(r) for _ in range(r.randrange(0, 5))]


def test_random_records(spark):
    r = random.Random(5)
    records = [record(r) for _ in range(60)]
    pairs = [(i, *r.choice(records), *r.choice(records)) for i in range(900)]
    pairs += [(900 + i, t, a, t.upper(), list(reversed(a))) for i, (t, a) in enumerate(records)]
    table = spark.createDataFrame([(*p, "old") for p in pairs], "id long, title_a string, names_a array<string>, title_b string, names_b array<string>, score string")
    got = {x.id: x for x in score_pairs(table).collect()}
    assert len(got) == len(pairs)
    for i, ta, aa, tb, ab in pairs:
        want = plain.title_similarity(title_key(ta), title_key(tb)), plain.author_coverage(aa, ab), plain.record_score(ta, aa, tb, ab)
        assert all(abs(x - y) < 1e-9 for x, y in zip((got[i].title, got[i].coverage, got[i].score), want, strict=True)), (ta, aa, tb, ab, got[i], want)


def test_nulls_repeats_and_empty_table(spark):
    kind = "title_a string, names_a array<string>, title_b string, names_b array<string>"
    rows = [(None, None, "x", ["A B"]), ("x", ["A B"], None, None), ("x y", ["A B"], "x y", ["A B"]), ("x y", ["A B"], "x y", ["A B"])]
    got = sorted((x.title, x.coverage, x.score) for x in score_pairs(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0.0, 0.0, 0.0)] * 2 + [(1.0, 1.0, 1.0)] * 2
    assert score_pairs(spark.createDataFrame(rows, kind).where(F.lit(False))).count() == 0
