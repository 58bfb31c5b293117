"""Short versions take a plainer path to the same edges and the same differences."""

import random

import numpy as np
import pytest

from clauseframe.plans import align, assignment

WORDS = "rent is due on the first day of a month and all keys go back".split()


def clauses(r, n):
    return [assignment.Clause(" ".join(r.choices(WORDS, k=r.randint(0, 12))) + r.choice(["", "\nrest"]), k / max(1, n - 1)) for k in range(n)]


@pytest.mark.parametrize("seed", range(30))
def test_few_clauses_have_the_edges_of_the_index(monkeypatch, seed):
    r = random.Random(seed)
    before, after = clauses(r, r.randint(1, 8)), clauses(r, r.randint(1, 8))
    few = assignment.edges(before, after)
    index = assignment.Index(after)
    for a in before:
        want = np.array(index.scores(a)).T
        assert want.tolist() == [[*assignment.scored(a, b)] for b in after]
    monkeypatch.setattr(assignment, "FEW", 0)
    assert [(x.tolist(), x.dtype) for x in few] == [(x.tolist(), x.dtype) for x in assignment.edges(before, after)]


@pytest.mark.parametrize("seed", range(60))
def test_a_small_table_gives_the_same_differences(monkeypatch, seed):
    r = random.Random(seed)
    a, b = (" ".join(r.choices(WORDS[: r.randint(1, 12)], k=r.randint(0, 25))) for _ in range(2))
    small = align.word_diff(a, b)
    monkeypatch.setattr(align, "SMALL", -1)
    assert small == align.word_diff(a, b)


def test_a_short_pair_builds_no_index(monkeypatch):
    monkeypatch.setattr(assignment, "Index", None)
    monkeypatch.setattr(align, "Path", None)
    assert align.aligned(["1. the rent is due"], ["1. the rent is paid"])[0][2] == "MODIFIED"
    assert align.word_diff("a b", "a c") == [("equal", "a "), ("delete", "b"), ("insert", "c")]


@pytest.mark.parametrize("name", ["lis_moved", "agreement_diffs"])
def test_no_clause_goes_through_the_driver(spark, capsys, name):
    import __spark_entry__ as entry

    entry.queries()[name](spark, "/root/testdata/sf0.001").explain()
    assert "BroadcastExchange" not in capsys.readouterr().out
