"""One-to-one assignment of the clauses that two versions do not have word for word, for versions of any length.

Both sides are dealt into blocks of ``BLOCK`` clauses. The task that has a block of each puts the later one into an inverted
index of trigrams and words, and gives an edge for each pair that could be accepted as one clause revised: ``MATCH`` likeness, or one
text ``CONTAINED`` in the other. Edges fall apart into connected parts, and each part is assigned exactly. A pair that has no
edge weighs nothing, so it cannot take a clause away from a pair that has one.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.streams import in_groups, remembered

MATCH, CONTAINED = 0.45, 0.85
BLOCK = 256
EDGE = "pair_id long, i int, j int, score double"


@remembered
def features(text: str) -> tuple[Counter, int, set[str], str]:
    """Trigrams and how many there are, words, and the first line if it may be a heading."""
    flat = "".join(text.split())
    line = text.split("\n", 1)[0]
    return Counter([flat[i : i + 3] for i in range(len(flat) - 2)]), max(0, len(flat) - 2), {w for w in re.findall(r"[^\W_]+", text) if len(w) > 1}, line.strip() if len(line.split()) <= 7 else ""


class Clause:
    """What the comparison needs of a clause."""

    def __init__(self, text: str, at: float):
        self.text, self.at = text, at
        self.grams, self.n, self.words, self.heading = features(text)


def overlap(a: Clause, b: Clause) -> int:
    small, large = sorted((a.grams, b.grams), key=len)
    return sum(min(n, large[g]) for g, n in small.items() if g in large)


def containment(part: Clause, whole: Clause) -> float:
    return overlap(part, whole) / part.n if part.n else 0.0


class Index:
    """A block of clauses, by trigram and by word."""

    def __init__(self, clauses: list[Clause]):
        self.size = len(clauses)
        self.grams: dict[str, int] = {}
        self.words: dict[str, int] = {}
        for c in clauses:
            for x in c.grams:
                self.grams.setdefault(x, len(self.grams))
            for x in c.words:
                self.words.setdefault(x, len(self.words))
        self.counts = np.zeros((len(self.grams), self.size), np.int32)
        self.has = np.zeros((len(self.words), self.size), np.int32)
        for j, c in enumerate(clauses):
            self.counts[[self.grams[x] for x in c.grams], j] = list(c.grams.values())
            self.has[[self.words[x] for x in c.words], j] = 1
        self.n, self.n_words = np.array([c.n for c in clauses]), np.array([len(c.words) for c in clauses])
        self.at, self.headings = np.array([c.at for c in clauses]), np.array([c.heading for c in clauses], object)

    def scores(self, c: Clause) -> tuple[np.ndarray, np.ndarray]:
        """(likeness, the larger share of one text in the other) of ``c`` and each clause of the block: 0.6 Dice of trigrams, 0.25
        Jaccard of words, 0.1 for one heading, 0.05 for one place."""
        known = [(self.grams[x], n) for x, n in c.grams.items() if x in self.grams]
        own, n = np.array(known, np.int64).reshape(-1, 2).T
        shared = np.minimum(self.counts[own], n[:, None]).sum(axis=0)
        words = self.has[[self.words[x] for x in c.words if x in self.words]].sum(axis=0)
        dice = 2 * shared / np.maximum(1, c.n + self.n)
        jaccard = words / np.maximum(1, len(c.words) + self.n_words - words)
        heading = (self.headings == c.heading) & bool(c.heading)
        likeness = 0.6 * dice + 0.25 * jaccard + 0.1 * heading + 0.05 * (1 - np.abs(c.at - self.at))
        return likeness, np.maximum(shared / np.maximum(1, self.n), shared / max(1, c.n))


#: Pairs of clauses up to which an index costs more than it saves.
FEW = 64


def scored(a: Clause, b: Clause) -> tuple[float, float]:
    """What ``Index.scores`` gives for one pair."""
    shared, words = overlap(a, b), len(a.words & b.words)
    dice = 2 * shared / max(1, a.n + b.n)
    jaccard = words / max(1, len(a.words) + len(b.words) - words)
    likeness = 0.6 * dice + 0.25 * jaccard + 0.1 * (bool(a.heading) and a.heading == b.heading) + 0.05 * (1 - abs(a.at - b.at))
    return likeness, max(shared / max(1, b.n), shared / max(1, a.n))


def edges(before: list[Clause], after: list[Clause]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, likeness) of all pairs that could be accepted."""
    rows, columns, scores = [], [], []
    if 0 < len(before) * len(after) <= FEW:
        pairs = ((i, j, *scored(a, b)) for i, a in enumerate(before) for j, b in enumerate(after))
        found = [(i, j, s) for i, j, s, held in pairs if s >= MATCH or held >= CONTAINED]
        rows, columns, scores = ([np.array(c)] for c in zip(*found, strict=True)) if found else ([], [], [])
    elif before and after:
        index = Index(after)
        for i, c in enumerate(before):
            likeness, held = index.scores(c)
            j = np.flatnonzero((likeness >= MATCH) | (held >= CONTAINED))
            rows.append(np.full(len(j), i))
            columns.append(j)
            scores.append(likeness[j])
    joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return joined(rows, np.int64), joined(columns, np.int64), joined(scores, np.float64)


def parts(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of each edge's connected part: its smallest row."""
    if len(set(i.tolist())) == len(set(j.tolist())) == len(i):
        return i  # no two edges share an end
    rows, r = np.unique(i, return_inverse=True)
    columns, c = np.unique(j, return_inverse=True)
    label, below = np.arange(len(rows)), np.full(len(columns), len(rows))
    while True:
        np.minimum.at(below, c, label[r])
        new = label.copy()
        np.minimum.at(new, r, below[c])
        new = new[new]  # a row takes the part that its part's row has found
        if (new == label).all():
            return rows[label[r]]
        label = new


def matching(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> dict[int, int]:
    """row -> column of the one-to-one choice of edges with the greatest total score, all scores in 0 to 1. A row may stay alone.

    Shortest augmenting paths, a row after another, over the edges only: for each row the cheapest alternating path to a free
    column, or to a row that is better left alone, where an edge costs 1 - score and staying alone 1.
    """
    if len(i) == 1:
        return {int(i[0]): int(j[0])}
    rows, r = np.unique(i, return_inverse=True)
    columns, c = np.unique(j, return_inverse=True)
    n, m = len(rows), len(columns)
    near: list[list[tuple[int, float]]] = [[(m + k, 1.0)] for k in range(n)]  # staying alone is a column of one's own
    for a, b, s in zip(r.tolist(), c.tolist(), score.tolist(), strict=True):
        near[a].append((b, 1.0 - s))
    u, v = [0.0] * n, [0.0] * (m + n)
    owner, seat = [-1] * (m + n), [-1] * n
    for start in range(n):
        far: dict[int, float] = {}
        came: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        row, so_far = start, 0.0
        while True:
            for b, cost in near[row]:
                d = so_far + cost - u[row] - v[b]
                if b not in done and d < far.get(b, np.inf):
                    far[b], came[b] = d, row
                    heapq.heappush(heap, (d, b))
            so_far, end = heapq.heappop(heap)
            while end in done:
                so_far, end = heapq.heappop(heap)
            if owner[end] < 0:
                break
            done.add(end)
            row = owner[end]
        for b in done:
            v[b] -= so_far - far[b]
            u[owner[b]] += so_far - far[b]
        u[start] += so_far
        while True:
            row = came[end]
            owner[end], seat[row], end = row, end, seat[row]
            if row == start:
                break
    return {int(rows[k]): int(columns[b]) for k, b in enumerate(seat) if b < m}


def all_edges(clauses: DataFrame) -> DataFrame:
    """pair_id, i, j, score of the acceptable pairs among ``clauses`` (pair_id, side, i, at, text): blocks of the earlier side meet blocks of
    the later one, as many groups as the lengths ask for."""
    of = Window.partitionBy("pair_id")
    early = F.col("side") == "before"
    own = F.floor(F.col("i") / BLOCK).cast("int")
    most = lambda side: F.max(F.when(F.col("side") == side, own)).over(of)
    met = clauses.withColumns({"own": own, "most_x": most("before"), "most_y": most("after")}).where("most_x IS NOT NULL AND most_y IS NOT NULL")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(early, F.col("most_y")).otherwise(F.col("most_x")))))
    block = lambda mine: F.when(early == mine, F.col("own")).otherwise(F.col("other"))
    met = met.select("pair_id", block(True).alias("x"), block(False).alias("y"), "side", "i", "at", "text")

    def meet(key: tuple, both: list[tuple]) -> Iterator[tuple]:
        before, after = ([(i, Clause(t or "", at)) for side, i, at, t in both if side == s] for s in ("before", "after"))
        found = edges([c for _, c in before], [c for _, c in after])
        for i, j, score in zip(*(x.tolist() for x in found), strict=True):
            yield key[0], before[i][0], after[j][0], score

    return in_groups(met, ["pair_id", "x", "y"], ["i"], meet, EDGE)


def assigned(found: DataFrame) -> DataFrame:
    """The edges of ``all_edges`` that the assignment takes. A pair of versions is one group only to number its parts, from whole
    numbers; a part is one group of the assignment."""

    def numbered(key: tuple, pair: list[tuple]) -> Iterator[tuple]:
        i, j = (np.array([r[c] for r in pair], np.int64) for c in (0, 1))
        return ((*key, *r, part) for r, part in zip(pair, parts(i, j).tolist(), strict=True))

    def one(key: tuple, part: list[tuple]) -> Iterator[tuple]:
        i, j, score = (np.array([r[c] for r in part]) for c in range(3))
        taken = matching(i, j, score)
        return ((key[0], *r) for r in part if taken.get(r[0]) == r[1])

    return in_groups(in_groups(found, ["pair_id"], ["i", "j"], numbered, f"{EDGE}, part int"), ["pair_id", "part"], ["i", "j"], one, EDGE)
