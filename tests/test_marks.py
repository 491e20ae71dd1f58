import random

import pytest

from folioscope.operators.asof import followed, latest_before
from folioscope.operators.marks import SCHEMAS, Reviewed, replay_asked, replay_marks
from folioscope.operators.snapshots import Snapshots
from folioscope.streaming.marks import ingest_marks, stored_review

MARKS = "seq long, phrase string, status string, alias_of string"


class Plain:
    """One mark after another."""

    def __init__(self):
        self.keywords, self.aliases, self.math, self.ignored, self.links = {}, {}, set(), set(), set()

    def drop(self, phrase):
        self.keywords.pop(phrase, None)
        self.aliases = {a: k for a, k in self.aliases.items() if k != phrase}
        self.links = {(p, k) for p, k in self.links if k != phrase}

    def mark(self, phrase, status, of):
        if not phrase:
            return None
        self.math.discard(phrase)
        self.ignored.discard(phrase)
        self.aliases.pop(phrase, None)
        if status == "useful" or (status == "alias" and of and of not in self.keywords):
            self.keywords.setdefault(phrase, 5)
            return "useful"
        if status == "alias" and of and of != phrase:
            if phrase in self.keywords:
                self.links |= {(p, of) for p, k in self.links if k == phrase}
                self.aliases |= {a: of for a, k in self.aliases.items() if k == phrase}
                self.drop(phrase)
            self.aliases[phrase] = of
            return "alias"
        self.drop(phrase)
        if status in ("math", "ignore"):
            (self.math if status == "math" else self.ignored).add(phrase)
            return status
        return "unreviewed"

    def rows(self):
        return {"keywords": set(self.keywords.items()), "aliases": set(self.aliases.items()), "math": {(p,) for p in self.math}, "ignored": {(p,) for p in self.ignored}, "links": self.links}

    def state(self, spark):
        return Reviewed(**{name: spark.createDataFrame(sorted(self.rows()[name]), schema) for name, schema in SCHEMAS.items()})


def rows(state):
    found = {name: [tuple(r) for r in getattr(state, name).collect()] for name in SCHEMAS}
    assert all(len(r) == len(set(r)) for r in found.values())
    return {name: set(r) for name, r in found.items()}


def some_marks(rng, n, phrases):
    hot = lambda: "a" if rng.random() < 0.35 else rng.choice(phrases)
    return [(seq, hot(), rng.choice(["useful", "alias", "alias", "alias", "math", "ignore", "unreviewed"]), rng.choice([hot(), hot(), hot(), None, ""])) for seq in range(0, 3 * n, 3)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_marks_like_one_after_another(spark, seed):
    rng = random.Random(seed)
    phrases = list("abcdefgh") if seed == 1 else [f"p{i}" for i in range(40)] + ["a"]
    plain = Plain()
    for phrase in phrases[::2]:
        plain.keywords[phrase] = rng.randint(1, 10)
        plain.links |= {(rng.randint(1, 9), phrase) for _ in range(3)}
    plain.aliases = {"x": phrases[0], "y": phrases[0], "z": phrases[2]}
    plain.math, plain.ignored = {phrases[1]}, {phrases[3]}
    before = plain.state(spark)
    marks = some_marks(rng, 120, [*phrases, "x", "y"]) + [(1000, None, "useful", None), (1001, "", "math", None), (1002, "a", "odd", None)]
    wanted = [(seq, phrase, plain.mark(phrase, status, of)) for seq, phrase, status, of in marks]
    after, answers = replay_marks(before, spark.createDataFrame(rng.sample(marks, len(marks)), MARKS))
    assert rows(after) == plain.rows()
    assert sorted(tuple(r) for r in answers.collect()) == [w for w in wanted if w[2]]


def test_five_target_states_and_no_marks(spark):
    marks = spark.createDataFrame([(1, "k", "useful", None), (2, "s", "alias", "k"), (3, "m", "math", None), (4, "i", "ignore", None), (5, "u", "math", None), (6, "u", "unreviewed", None), (7, "n", "alias", "not there")], MARKS)
    state, _ = replay_marks(Reviewed.empty(spark), marks)
    wanted = {"keywords": {("k", 5), ("n", 5)}, "aliases": {("s", "k")}, "math": {("m",)}, "ignored": {("i",)}, "links": set()}
    assert rows(state) == wanted
    again, answers = replay_marks(state, marks.limit(0))
    assert rows(again) == wanted and answers.isEmpty()


def test_batches_do_not_matter(spark, scratch):
    """The same end state from a stream in several batches, and no batch counts twice."""
    rng, plain = random.Random(5), Plain()
    marks = some_marks(rng, 60, list("abcdef"))
    for _, phrase, status, of in marks:
        plain.mark(phrase, status, of)
    for n, part in enumerate((marks[:10], marks[10:45], marks[45:])):
        spark.createDataFrame(part, MARKS).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        table = Snapshots(spark, f"{scratch}/state")
        ingest_marks(spark.readStream.schema(MARKS).parquet(f"{scratch}/in"), table, f"{scratch}/checkpoint", availableNow=True).awaitTermination()
        assert table.version() == n + 1
    assert rows(stored_review(table)) == plain.rows()


def test_latest_before_in_small_blocks(spark):
    rng = random.Random(7)
    events = [(rng.choice("aaab"), at, (at,)) for at in rng.sample(range(-50, 300), 90)]
    probes = [(rng.choice(["a", "b", "c", None]), at) for at in range(-80, 330, 3)]
    found = latest_before(spark.createDataFrame(probes, "key string, at long"), spark.createDataFrame(events, "key string, at long, value struct<t:long>"), block=4)
    wanted = {(k, at, max((e[1] for e in events if e[0] == k and e[1] < at), default=None)) for k, at in probes}
    assert {(r.key, r.at, r.found and r.found.t) for r in found.collect()} == wanted


def test_large_and_small_keys_and_null_ones(spark):
    """Keys on both sides of the limit, probes at the times of rows, and a null key that is large itself."""
    rng = random.Random(8)
    events = [(rng.choice("aaaaaabc"), at, (at,)) for at in range(0, 400, 2)]
    probes = [(rng.choice(["a", "b", "d", None]), at, f"n{at}") for at in range(-10, 410)]
    found = latest_before(spark.createDataFrame(probes, "key string, at long, note string"), spark.createDataFrame(events, "key string, at long, value struct<t:long>"), block=4)
    assert found.columns == ["key", "at", "note", "found"]
    wanted = sorted((str(k), at, note, max((e[1] for e in events if e[0] == k and e[1] < at), default=-1)) for k, at, note in probes)
    assert sorted((str(r.key), r.at, r.note, r.found.t if r.found else -1) for r in found.collect()) == wanted


def test_rounds_write_only_the_nodes_that_moved(spark):
    """Nodes that end chains are written once, and other columns come along."""
    nodes = [(i, i - 1 if 0 < i < 9 else None, False, "end" if i == 0 else "own", f"n{i}") for i in range(500)]
    found = followed(spark.createDataFrame(nodes, "id long, up long, odd boolean, value string, note string"))
    assert {(r.id, r.value, r.note) for r in found.collect()} == {(i, "end" if i < 9 else "own", f"n{i}") for i in range(500)}
    roots = {name.rsplit("/", 1)[0] for name in found.inputFiles()}
    assert sum(spark.read.parquet(root).count() for root in roots) < 600


def test_marks_of_unknown_status_and_what_was_asked(spark):
    marks = spark.createDataFrame([(1, "k", "useful", None), (2, "k", None, None), (3, "a", "alias", "k"), (4, "b", "alias", "a")], MARKS)
    state, answers = replay_asked(Reviewed.empty(spark), marks)
    assert sorted((r.seq, r.asked, r.status) for r in answers.collect()) == [(1, "useful", "useful"), (2, None, "unreviewed"), (3, "alias", "useful"), (4, "alias", "alias")]
    assert rows(state) == {"keywords": {("a", 5)}, "aliases": {("b", "a")}, "math": set(), "ignored": set(), "links": set()}


def test_long_chains(spark):
    nodes = [((i,), (i - 1,) if i else None, i % 3 == 0 and i > 0, "end" if i == 0 else None) for i in range(200)]
    found = followed(spark.createDataFrame(nodes, "id struct<n:int>, up struct<n:int>, odd boolean, value string"))
    assert {(r.id.n, r.odd, r.value) for r in found.collect()} == {(i, (i // 3) % 2 == 1, "end") for i in range(200)}
