"""Review passes over stored state against a plain replay, one decision after another."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators.replay import PASSES, apply_decisions

PAPERS = "paper_id long, doi string, doi_status string, doi_confidence double, journal_ref string"
CANDIDATES = "candidate_id long, paper_id long, doi string, status string, confidence double"
DECISIONS = "candidate_id long, decision string, linked_doi string, confidence double"
NO_DOI = "Journal of Integer Sequences, Vol. 15"


def replay(papers, candidates, decisions):
    papers, candidates, applied = {p[0]: list(p) for p in papers}, [list(c) for c in candidates], []
    by_id = {c[0]: c for c in candidates}
    for name in PASSES:
        for cid, decision, linked, confidence in sorted(d for d in decisions if d[1] == name):
            c = by_id.get(cid)
            if c is None or c[3] != "pending" or c[1] not in papers:
                continue
            p = papers[c[1]]
            others = lambda doi: any(q[1] == doi for q in papers.values() if q[0] != p[0])  # noqa: B023, E731
            if name == "reject_conflict_assigned_better":
                if c[2] is not None and others(c[2]):
                    c[3] = "rejected"
                    applied.append((cid, p[0], name, c[2], confidence))
                continue
            if p[1] is not None:
                continue
            if name == "skip_known_doi_less":
                if "integer sequences" in (p[4] or "").lower():
                    p[2] = "skipped"
                    applied.append((cid, p[0], name, None, confidence))
                    for other in candidates:
                        if other[1] == p[0] and other[3] == "pending":
                            other[3] = "rejected"
                continue
            doi = linked if name == "approve_replacement" else c[2]
            if doi is None or others(doi):
                continue
            if name == "approve_replacement" and any(o[2] == doi and o[1] != p[0] and o[3] == "pending" for o in candidates):
                continue
            p[1:4] = [doi, "auto", confidence]
            applied.append((cid, p[0], name, doi, confidence))
            for other in candidates:
                if other[1] == p[0] and other[3] == "pending":
                    other[3] = "approved" if other is c and name != "approve_replacement" else "rejected"
            if name == "approve_replacement":
                held = next((o for o in candidates if o[1] == p[0] and o[2] == doi), None)
                if held:
                    held[3:] = ["approved", confidence]
                else:
                    candidates.append([None, p[0], doi, "approved", confidence])
    return sorted(map(tuple, papers.values())), sorted(map(tuple, candidates), key=repr), sorted(applied, key=repr)


def frames(spark, papers, candidates, decisions):
    return spark.createDataFrame(papers, PAPERS), spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(decisions, DECISIONS)


def same(got, want):
    assert sorted(map(tuple, got.papers.collect())) == want[0]
    assert sorted(map(tuple, got.candidates.collect()), key=repr) == want[1]
    assert sorted(map(tuple, got.applied.collect()), key=repr) == want[2]


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_replay(spark, seed):
    r = random.Random(seed)
    dois = [f"10.1/{i}" for i in range(12 if seed % 2 else 40)]
    papers = [(i, r.choice([*dois, *[None] * 60]), None, None, r.choice([None, "Adv. Math. 3", NO_DOI])) for i in range(30)]
    pairs = sorted({(r.randrange(32), r.choice(dois)) for _ in range(90)})
    r.shuffle(pairs)
    candidates = [(i, p, d, r.choice(["pending"] * 9 + ["rejected"]), 0.5) for i, (p, d) in enumerate(pairs)]
    kinds = [*PASSES, "approve_replacement", "approve_replacement", "review_high_evidence"]
    decisions = [(i, r.choice(kinds), r.choice([*dois, None]), r.randrange(100) / 100) for i in range(len(candidates) + 3)]
    same(apply_decisions(*frames(spark, papers, candidates, decisions)), replay(papers, candidates, decisions))


def test_one_identifier_for_very_many(spark):
    """A third of all candidates name one doi: rounds stay few, as those that can't hold go at once."""
    n = 300
    papers = [(i, None, None, None, None) for i in range(n)]
    candidates = [(i, i, "10.1/hot" if i % 3 == 0 else f"10.1/{i}", "pending", 0.5) for i in range(n)]
    decisions = [(i, ["approve_confirmed", "approve_replacement", "approve_metadata_exact"][i % 3], "10.1/hot", 0.9) for i in range(n)]
    same(apply_decisions(*frames(spark, papers, candidates, decisions)), replay(papers, candidates, decisions))


def test_each_pass_and_empty_tables(spark):
    papers = [(1, None, None, None, None), (2, "10.1/b", "verified", 1.0, None), (3, None, None, None, NO_DOI), (4, None, None, None, None), (5, None, None, None, "Adv. Math."), (6, None, None, None, None)]
    candidates = [(10, 1, "10.1/a", "pending", 0.5), (11, 1, "10.1/z", "pending", 0.5), (12, 4, "10.1/b", "pending", 0.5), (13, 3, "10.1/s", "pending", 0.5), (14, 5, "10.1/old", "pending", 0.5), (15, 6, "10.1/new", "rejected", 0.1), (16, 6, "10.1/x", "pending", 0.1)]
    decisions = [(10, "approve_confirmed", None, 0.9), (11, "approve_exact_external", None, 0.8), (12, "reject_conflict_assigned_better", None, None), (13, "skip_known_doi_less", None, None), (14, "skip_known_doi_less", None, None), (16, "approve_replacement", "10.1/new", 0.7)]
    tables = frames(spark, papers, candidates, decisions)
    got = apply_decisions(*tables)
    same(got, replay(papers, candidates, decisions))
    assert {r.paper_id: (r.doi, r.doi_status) for r in got.papers.collect()} == {1: ("10.1/a", "auto"), 2: ("10.1/b", "verified"), 3: (None, "skipped"), 4: (None, None), 5: (None, None), 6: ("10.1/new", "auto")}
    assert {r.candidate_id: r.status for r in got.candidates.collect()} == {10: "approved", 11: "rejected", 12: "rejected", 13: "rejected", 14: "pending", 15: "approved", 16: "rejected"}
    none = apply_decisions(*(t.where(F.lit(False)) for t in tables))
    assert none.papers.count() == none.candidates.count() == none.applied.count() == 0
