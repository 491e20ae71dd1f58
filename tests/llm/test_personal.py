"""Base spans against plain Python; what the method adds; masking."""

import collections
import random
import re
import time

from pyspark.sql import functions as F

from folioscope.llm.personal_data import KINDS, base_spans, find_spans, fit, mask_personal_data, masked, reliabilities

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", "no data here", "mail a.b@x.org, c@d@e.fr..g@h.co x@a.b.c.d.e", "a@b.c..d@e.f", "é😀 a@b.io é 10.0.0.1", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4117640103996265", "12  34 4111 1111  1111 1111 " + "1 " * 3000, "+1 (547) 555-0128 +1 +12-3 ++49 30 1234567.", "call (547) 555-0128 now", "+" + "1" * 5000,
    "x@" + "a." * 4000 + "z", "a" * 20000 + "@", "write to ann (at) example (dot) com",
]


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    found = find_spans(df, fit(df)).collect()
    assert len(found) == len(TEXTS)
    for row in found:
        text = row.text or ""
        expected = [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text) if valid(k, m.group())]
        assert [(s.kind, s.start, s.end) for s in row.spans if s.base] == expected
        taken = [(s.start, s.end) for s in row.spans]
        assert all(not (s.start < e and b < s.end) for s in row.spans if not s.base for b, e in taken if (b, e) != (s.start, s.end))


def test_mask_and_empty_table(spark):
    df = spark.createDataFrame([(1, "to a@b.io from 10.0.0.1!"), (2, None), (3, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in mask_personal_data(df).collect()}
    assert got == {1: "to [EMAIL] from [IP]!", 2: None, 3: "plain"}
    empty = df.where(F.lit(False))
    assert find_spans(empty, fit(empty)).count() == 0


def added(rows):
    return [(r.text, [r.text[s.start : s.end] for s in r.spans if not s.base]) for r in rows]


PLANTED = {
    "write to jane.doe (at) mail.example dot com today": ["jane.doe (at) mail.example dot com"],
    "mail: jo_12 [at] example [dot] org, thanks": ["jo_12 [at] example [dot] org"],
    "contact ann (AT) example.com now": ["ann (AT) example.com"],
    "mail me at jo_12 at example.org soon": ["jo_12 at example.org"],
    "my host 10[.]20[.]30[.]40 is down": ["10[.]20[.]30[.]40"],
    "server address 2001:db8:0:1:2:3:4:5 here": ["2001:db8:0:1:2:3:4:5"],
    "call me: (312) 555-7788.": ["(312) 555-7788"],
    "phone number 312-555-7788 works": ["312-555-7788"],
    "phone 0049 30 1234 5678 please": ["0049 30 1234 5678"],
    "amex card 3782 822463 10005 ok": ["3782 822463 10005"],
}
CLEAN = [
    "version 3:12:45 of order 123-456-7890123", "see section 10.2.3 and page 44", "isbn 978-3-16-148410-0 at the shop", "look at this. point", "ratio 3:4:5 at 12 o'clock",
    "hosted at flickr.com and look at example.net", "attionen from at and. Of the rest", "Part number 123-456-7000 and serial 206.555.1000", "serial (206) 555-1000 at the back",
    "contact us at example.com or write at once. Then go", "call 3 of 12 at 10.5 percent", "see me @ example.org", "code 1234567890123 and 00123 45 67", "std::dec and ab::cd are names",
]
BASE = ["mail a.b@example.com", "card 4111 1111 1111 1111 paid", "host 10.1.2.3 up", "tel +1 (312) 555-7788", "x@y.zz"]


def test_added_spans(spark):
    """What the strict patterns miss is found in these lines, and nothing else: every added span counts."""
    texts = [*PLANTED, *CLEAN, *BASE] * 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = added(find_spans(docs, fit(docs)).collect())
    right = wrong = 0
    for text, spans in found:
        wanted = PLANTED.get(text, [])
        right, wrong = right + len([s for s in spans if s in wanted]), wrong + len([s for s in spans if s not in wanted])
    assert wrong == 0, [f for f in found if set(f[1]) - set(PLANTED.get(f[0], []))]
    assert right >= 0.9 * 6 * len(PLANTED), [f for f in found if f[0] in PLANTED and f[1] != PLANTED[f[0]]]


def test_prose_beside_obfuscated_addresses(spark):
    plain = ["mail ann@example.com or +1 (312) 555-7788 today"] * 60
    prose = ["hosted at flickr.com and look at example.net"] * 30 + ["Part number 123-456-7000 and serial 206.555.1000"] * 20
    docs = spark.createDataFrame(list(enumerate([*plain, *prose, *["bob (at) mail (dot) com"] * 20])), "doc_id long, text string")
    found = added(find_spans(docs, fit(docs)).collect())
    assert [s for text, spans in found for s in spans] == ["bob (at) mail (dot) com"] * 20
    masks = {r.text for r in mask_personal_data(docs).select("text").distinct().collect()}
    assert masks == {"mail [EMAIL] or [PHONE] today", *prose, "[EMAIL]"}


def test_reliabilities_of_planted_labelers(spark):
    rng = random.Random(4)
    planted = [(0.95, 0.9), (0.9, 0.8), (0.85, 0.9), (0.8, 0.7), (0.99, 0.02), (0.9, 0.95)]  # the fifth always says yes
    rows = collections.Counter()
    for _ in range(6000):
        real = rng.random() < 0.6
        rows[tuple(int(rng.random() < (sens if real else 1 - spec)) for sens, spec in planted)] += 1
    patterns = spark.createDataFrame([("email", list(v), n) for v, n in rows.items()], "kind string, votes array<int>, n long")
    got = reliabilities(patterns, rounds=40).first()
    assert all(abs(a - b) < 0.05 for a, (b, _) in zip(got.sensitivity, planted, strict=True)), got
    assert all(abs(a - b) < 0.05 for a, (_, b) in zip(got.specificity, planted, strict=True)), got
    assert abs(got.prior - 0.6) < 0.04


def test_very_many_matches(spark):
    text = " ".join(f"u{i}@h{i % 7}.example.com" for i in range(16000))
    spans = spark.createDataFrame([(text,)], "text string").select(base_spans(F.col("text")).alias("s"))
    spans.collect()
    began = time.perf_counter()
    got = spans.first().s
    assert time.perf_counter() - began < 10
    assert [(s.start, s.end) for s in got] == [m.span() for m in re.finditer(r"\S+", text)]


def test_very_many_loose_and_added_spans(spark):
    """Loose spans beside as many base spans, added ones, and masking of all of them."""
    line = " ".join(f"u{10000 + i}@h{i % 7}.example.com or v{10000 + i} (at) mail (dot) com" for i in range(8000)) + " end"
    docs = spark.createDataFrame([(i, line if i == 0 else "bob (at) mail (dot) com and a.b@example.com") for i in range(40)], "doc_id long, text string")
    began = time.perf_counter()
    row = find_spans(docs, fit(docs)).where("doc_id = 0").first()
    assert [(s.start, s.end, s.base) for s in row.spans if not s.base] == [(*m.span(), False) for m in re.finditer(r"v\d+ \(at\) mail \(dot\) com", line)]
    assert sum(s.base for s in row.spans) == 8000
    masks = mask_personal_data(docs.where("doc_id = 0")).first().text
    assert masks == re.sub(r"u\d+\S+|v\d+ \(at\) mail \(dot\) com", "[EMAIL]", line)
    assert time.perf_counter() - began < 60


def test_masking_of_overlapping_spans(spark):
    spans = "array(named_struct('kind', 'phone', 'start', 6, 'end', 9), named_struct('kind', 'card', 'start', 2, 'end', 5), named_struct('kind', 'ip', 'start', 4, 'end', 7), named_struct('kind', 'email', 'start', 12, 'end', 14))"
    got = spark.sql(f"SELECT 'ab\u00e9defghijklmnop' AS t, {spans} AS s").select(masked(F.col("t"), F.col("s")).alias("m")).first().m
    assert got == "ab[CARD]jkl[EMAIL]op"
