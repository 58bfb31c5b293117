"""The blockwise assignment against dense results, at length."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest

from clauseframe.plans import align, assignment
from clauseframe.plans.assignment import CONTAINED, MATCH, Clause, Index, edges, matching, overlap, parts

WORDS = [f"{a}{b}" for a in ("rent", "pay", "keep", "lease", "flat", "roof", "month", "notice") for b in ("", "s", "ing", "er", "al")]


def clause(rng, n=14):
    return " ".join(rng.choices(WORDS, k=n))


def edited(rng, text):
    words = text.split()
    for _ in range(rng.randrange(1, 5)):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def plain_scores(a, b):
    shared = overlap(a, b)
    dice = 2 * shared / (a.n + b.n) if a.n + b.n else 0.0
    jaccard = len(a.words & b.words) / max(1, len(a.words | b.words))
    likeness = 0.6 * dice + 0.25 * jaccard + 0.1 * (bool(a.heading) and a.heading == b.heading) + 0.05 * (1 - abs(a.at - b.at))
    return likeness, max(shared / a.n if a.n else 0, shared / b.n if b.n else 0)


def test_a_block_scores_as_pair_by_pair():
    rng = random.Random(1)
    made = [Clause(t, rng.random()) for t in [clause(rng, rng.randrange(0, 12)) for _ in range(40)] + ["", "a", "ab\ncd", "short\nbody " * 3]]
    index = Index(made)
    for a in made:
        likeness, held = index.scores(a)
        for j, b in enumerate(made):
            want = plain_scores(a, b)
            assert abs(likeness[j] - want[0]) < 1e-12 and abs(held[j] - want[1]) < 1e-12


def test_parts_are_connected():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        i, j = rng.integers(0, 15, n), rng.integers(0, 15, n)
        reach = {("r", x): {("r", x)} for x in i} | {("c", y): {("c", y)} for y in j}
        for x, y in zip(i, j, strict=True):
            both = reach["r", x] | reach["c", y]
            for k in both:
                reach[k] = both
        assert parts(i, j).tolist() == [min(k for side, k in reach["r", x] if side == "r") for x in i]
    chain = np.arange(3000)
    assert set(parts(np.append(chain, chain[1:]), np.append(chain, chain[:-1])).tolist()) == {0}


def test_sparse_matching_is_the_dense_optimum():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = (int(x) for x in rng.integers(1, 6, 2))
        dense = np.where(rng.random((n, m)) < 0.6, rng.integers(0, 8, (n, m)) / 8, 0.0)
        i, j = np.nonzero(dense)
        got = matching(i, j, dense[i, j])
        assert len(set(got.values())) == len(got) and all(dense[a, b] > 0 for a, b in got.items())
        square = np.zeros((max(n, m),) * 2)
        square[:n, :m] = dense
        best = max(sum(square[a, p[a]] for a in range(len(square))) for p in itertools.permutations(range(len(square))))
        assert abs(sum(dense[a, b] for a, b in got.items()) - best) < 1e-9
        together: dict = {}
        of = parts(i, j) if len(i) else i
        for p in np.unique(of):
            together |= matching(i[of == p], j[of == p], dense[i, j][of == p])
        assert abs(sum(dense[a, b] for a, b in together.items()) - best) < 1e-9


def test_a_worse_pair_gives_way_along_a_path():
    # row 0 could have both columns; the others have one choice each
    assert matching(np.array([0, 0, 1, 2]), np.array([0, 1, 0, 1]), np.array([0.9, 0.8, 0.85, 0.5])) == {0: 1, 1: 0}


def test_blocks_give_what_one_place_gives(spark, monkeypatch):
    rng = random.Random(4)
    rows, want = [], {}
    for pair in range(8):
        before = [clause(rng) for _ in range(rng.randrange(0, 25))]
        after = [edited(rng, t) if rng.random() < 0.6 else t for t in before if rng.random() < 0.9] + [clause(rng) for _ in range(3)]
        rng.shuffle(after)
        want[pair] = align.aligned(before, after)
        rows += [(pair, s, n, t) for s, own in (("before", before), ("after", after)) for n, t in enumerate(own)]
    rows += [(50, "after", 0, "only a later version"), (51, "before", 0, None), (51, "after", 0, ""), (52, "before", 0, "only an earlier one")]
    monkeypatch.setattr(assignment, "BLOCK", 4)
    frame = spark.createDataFrame(rows, "pair_id long, side string, ord int, text string")
    got: dict = {}
    for r in align.align(frame).collect():
        got.setdefault(r.pair_id, []).append((list(r.before), list(r.after), r.change, r.similarity, r.moved, r.renumbered))
    for pair, own in want.items():
        assert sorted(got[pair]) == sorted(own)
    assert [r[2] for r in got[50]] == ["ADDED"] and [r[2] for r in got[51]] == ["UNCHANGED"] and [r[2] for r in got[52]] == ["REMOVED"]


def test_edges_are_the_acceptable_pairs():
    rng = random.Random(5)
    before = [Clause(clause(rng), 0.3) for _ in range(30)]
    after = [Clause(edited(rng, c.text), 0.5) for c in before] + [Clause(before[0].text[:20], 0.1)]
    i, j, s = edges(before, after)
    want = {(a, b) for a in range(len(before)) for b in range(len(after)) if (p := plain_scores(before[a], after[b]))[0] >= MATCH or p[1] >= CONTAINED}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_a_long_agreement_is_many_tasks_work(spark):
    rng = random.Random(6)
    n = 5000
    before = [f"{k} {clause(rng, 18)} {rng.random()}" for k in range(n)]
    after = [edited(rng, t) for t in before]
    rows = [(1, s, k, t) for s, own in (("before", before), ("after", after)) for k, t in enumerate(own)]
    frame = spark.createDataFrame(rows, "pair_id long, side string, ord int, text string").repartition(8)
    found = align.align(frame).where("size(before) = 1 AND size(after) = 1 AND before[0] = after[0]").count()
    assert found >= 0.99 * n


# ---- word differences ------------------------------------------------------------------------------------------------


def plain_runs(x, y):
    """The runs from the whole table of lengths, deletions first."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            step = ("equal", x[i])
            i, j = i + 1, j + 1
        elif i < len(x) and (j == len(y) or best[i + 1][j] >= best[i][j + 1]):
            step, i = ("delete", x[i]), i + 1
        else:
            step, j = ("insert", y[j]), j + 1
        if out and out[-1][0] == step[0]:
            out[-1] = (step[0], out[-1][1] + step[1])
        else:
            out.append(step)
    return out


@pytest.mark.parametrize("box", [1, 6, 40, 2**20])
def test_differences_take_the_same_path_in_boxes_of_any_size(monkeypatch, box):
    monkeypatch.setattr(align, "BOX", box)
    rng = random.Random(box)
    for _ in range(150):
        a, b = (" ".join(rng.choices("abcd", k=rng.randrange(0, 25))) for _ in range(2))
        if rng.random() < 0.3:
            b = a[: rng.randrange(len(a) + 1)] + b[:5] + a[rng.randrange(len(a) + 1) :]
        assert align.word_diff(a, b) == plain_runs(align.TOKEN.findall(a), align.TOKEN.findall(b))


def test_differences_of_long_texts_hold_little():
    rng = random.Random(8)
    words = [str(rng.randrange(3000)) for _ in range(10_000)]
    other = [w if rng.random() < 0.9 else str(rng.randrange(3000)) for w in words]
    a, b = " ".join(words), " ".join(other)
    tracemalloc.start()
    runs = align.word_diff(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "".join(t for o, t in runs if o != "insert") == a and "".join(t for o, t in runs if o != "delete") == b
    assert most < 16e6  # the table's bits alone would take 50 MB
