from itertools import combinations

from folioscope.plans.linkage import match_score, title_similar_pairs
from tests.plain_matching import record_score

COMMON = ["on the trees of graphs", "the graphs of large trees on sets"]


def land(spark, scratch, titles):
    rows = [(i, f"https://h{i % 3}.org/{i}", f"<title>{t}</title>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{scratch}/pages.parquet")
    return rows


def test_titles_of_frequent_words(spark, scratch):
    """Every word is on more than 12 pages."""
    titles = [COMMON[i % 2] for i in range(40)] + ["on the trees of large graphs"] * 14 + ["sets", ""]
    land(spark, scratch, titles)
    sets = [frozenset(t.split()) for t in titles]
    first = {s: sets.index(s) for s in sets if s}
    expected = {(first[s], i): 1.0 for i, s in enumerate(sets) if s and first[s] != i}
    for x, y in combinations(sorted(first, key=first.get), 2):
        if len(x & y) >= 0.8 * len(x | y):
            expected[first[x], first[y]] = round(len(x & y) / len(x | y), 6)
    assert (0, 40) in expected
    assert {(r.a, r.b): r.jaccard for r in title_similar_pairs(spark, scratch).collect()} == expected


def test_records_of_frequent_words(spark, scratch):
    """Equal and similar titles on more than 12 pages get scores, and every page is in a row with its record."""
    titles = [COMMON[0]] * 30 + ["on the trees of large graphs"] * 3
    rows = land(spark, scratch, titles)
    found = {(r.a, r.b): r.score for r in match_score(spark, scratch).collect()}
    people = lambda i: [f"A {part}" for part in rows[i][1].split("/")[2].split(".")]
    pairs = [*combinations([0, 1, 2, 30, 31, 32], 2), *((i % 3, i) for i in range(3, 30))]
    assert found == {(a, b): round(record_score(titles[a], people(a), titles[b], people(b)), 3) for a, b in pairs}
