"""Label suggestions against the rules, phrase by phrase."""

import random

from pyspark.sql import functions as F

from folioscope.operators.suggestions import contained, suggest_labels


def brute(phrase, labels):
    lower, words = phrase.lower(), phrase.lower().split()
    norm = lower.replace(" ", "").replace("-", "").replace("_", "")
    out = []
    for _, key, title in sorted(labels):
        t, k = (title or "").lower(), key.lower().replace("-", "").replace("_", "")
        long, several = len(norm) >= 4, len(words) > 1
        rules = [
            lower == t, k == norm, long and (k.startswith(norm) or norm.startswith(k)), lower in t, t != "" and t in lower,
            long and (norm in k or k in norm), several and all(w in k for w in words), several and all(w in t for w in words),
        ]
        kind = next((i for i, r in enumerate(rules) if r), None)
        if kind is not None:
            out.insert(0, (key, kind)) if kind < 3 else out.append((key, kind))
    return out[:8]


def test_against_the_rules(spark):
    r = random.Random(9)
    words = ["schur", "e", "skew", "Macdonald", "poly", "nomial", "q-t", "k_schur", "s", "positivity", "é"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", "-", "_", ""]) for _ in range(n)).strip()
    labels = [(i, f"{text(2)}{i if i % 3 else ''}", r.choice([None, "", text(1), text(3)])) for i in range(80)]
    labels = [x for i, x in enumerate(labels) if x[1] and x[1] not in [y[1] for y in labels[:i]]]
    phrases = sorted({text(r.randrange(1, 4)) for _ in range(120)} | {title for _, _, title in labels if title} | {"schur  poly", "a"})
    table = spark.createDataFrame([(p,) for p in [*phrases, phrases[0], "", None]], "phrase string")
    found = suggest_labels(table, spark.createDataFrame(labels, "position long, key string, title string")).collect()
    from folioscope.operators.suggestions import KINDS

    got = {}
    for x in sorted(found, key=lambda x: (x.phrase, x["rank"])):
        got.setdefault(x.phrase, []).append((x.key, KINDS.index(x.kind)))
    assert got == {p: own for p in phrases if (own := brute(p, labels))}
    assert {k for own in got.values() for _, k in own} == set(range(8))


def test_no_nested_loop_and_empty_tables(spark):
    phrases = spark.createDataFrame([("a b",)], "phrase string")
    labels = spark.createDataFrame([(1, "a-b", "b")], "position long, key string, title string")
    plan = suggest_labels(phrases, labels)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert suggest_labels(phrases.where(F.lit(False)), labels).count() == 0
    assert suggest_labels(phrases, labels.where(F.lit(False))).count() == 0
    hays = spark.createDataFrame([(1, "aaaa"), (2, ""), (3, "xabcdeabcde")], "hay long, text string")
    needles = spark.createDataFrame([(1, "aa"), (2, "abcde"), (3, ""), (4, "aaaaa"), (5, "e")], "needle long, text string")
    assert sorted(map(tuple, contained(needles, hays).collect())) == [(1, 1), (2, 3), (5, 3)]
