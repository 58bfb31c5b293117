"""Alignment of two versions of a document, clause by clause.

Equal clauses are paired first, k-th with k-th; what is left is assigned one to one, see ``assignment``; clauses that were
split or merged join a neighbour's pair. Whatever grows with the product of the lengths is dealt into blocks and parts; what is done
for a pair of versions in one place is linear in their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.streams import in_groups, remembered
from .assignment import Clause, all_edges, assigned, containment, edges, matching

PART = 0.7
RESULT = "pair_id long, before array<int>, after array<int>, change string, similarity double, moved boolean, before_text string, after_text string, renumbered boolean"

#: What names a section: the word, then numbers that commas, dashes and the like join. Fixed patterns.
LABEL = r"\d{1,3}(?:\.\d{1,3})*"
NAMED = re.compile(rf"((?:סעיפים|סעיפי|סעיף|[Ss]ections?|[Cc]lauses?)\s+)({LABEL}(?:\s*(?:,|-|–|ו-?|עד|and|to)\s*{LABEL})*)")
OWN_LABEL = re.compile(rf"\s*(?:סעיף\s+)?({LABEL})\s*[.):\-]")


@remembered
def _normalized(text: str) -> str:
    plain = re.sub(r"^\s*\d+(?:\.\d+)*\s*[.):\-]?\s*", "", text)
    return " ".join(re.sub("[‘’‚׳]", "'", re.sub("[“”„״]", '"', plain)).split())


def normalized(text: str | None) -> str:
    return _normalized(text or "")


def own_label(text: str) -> str | None:
    """The number that a clause begins with."""
    found = OWN_LABEL.match(text or "")
    return found and found[1]


def renumbered(text: str, labels: dict[str, str]) -> str:
    """``text`` with each section number that it names replaced as ``labels`` says; of a number that is unknown as a whole, the
    main part is."""

    def one(label: re.Match) -> str:
        main, dot, rest = label[0].partition(".")
        return labels.get(label[0]) or labels.get(main, main) + dot + rest

    return NAMED.sub(lambda m: m[1] + re.sub(LABEL, one, m[2]), text or "")


def assign(cost: np.ndarray) -> list[int]:
    """The column of each row, or -1, at the lowest total cost; a row may stay alone for a cost of 1."""
    i, j = np.nonzero(np.asarray(cost) < 1)
    taken = matching(i, j, 1 - np.asarray(cost)[i, j])
    return [taken.get(k, -1) for k in range(len(cost))]


def increasing(values: list[int]) -> set[int]:
    """The positions of one longest increasing subsequence."""
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, x in enumerate(values):
        k = bisect_left(ends, x)
        back[i] = at[k - 1] if k else -1
        if k == len(ends):
            ends.append(x)
            at.append(i)
        else:
            ends[k], at[k] = x, i
    out, i = set(), at[-1] if at else -1
    while i >= 0:
        out.add(i)
        i = back[i]
    return out


def exact_pairs(before: list[str], after: list[str]) -> dict[int, int]:
    """Equal clauses, the k-th with the k-th."""
    seats: dict[str, list[int]] = {}
    for j, t in reversed([*enumerate(after)]):
        seats.setdefault(normalized(t), []).append(j)
    return {i: seats[key].pop() for i, t in enumerate(before) if seats.get(key := normalized(t))}


def place(i: int, n: int) -> float:
    return i / (n - 1) if n > 1 else 0.0


def assigned_here(before: list[str], after: list[str], pairs: dict[int, int]) -> list[tuple[int, int, float]]:
    """(i, j, likeness) of the clauses outside ``pairs`` that are assigned to each other."""
    taken = set(pairs.values())
    left, right = [i for i in range(len(before)) if i not in pairs], [j for j in range(len(after)) if j not in taken]
    i, j, score = edges([Clause(before[k], place(k, len(before))) for k in left], [Clause(after[k], place(k, len(after))) for k in right])
    likeness = {(a, b): s for a, b, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True)}
    return [(left[a], right[b], likeness[a, b]) for a, b in matching(i, j, score).items()]


def aligned(before: list[str], after: list[str], matched: list[tuple[int, int, float]] | None = None) -> list[tuple[list[int], list[int], str, float, bool, bool]]:
    """(before, after, change, similarity, moved, renumbered) in the order of the later version; removed clauses stand before what
    follows them. A pair is unchanged, and renumbered, if it differs only in naming sections by the numbers they have since.
    ``matched`` holds the assignment of what has no equal, if it is known."""
    pairs = exact_pairs(before, after)
    score = {i: 1.0 for i in pairs}
    for i, j, s in sorted(assigned_here(before, after, pairs) if matched is None else matched):
        pairs[i], score[i] = j, s
    rank = {i: n for n, i in enumerate(pairs)}
    back = {j: i for i, j in pairs.items()}
    made: dict[tuple[str, int], Clause] = {}
    clause = lambda side, k: made.get((side, k)) or made.setdefault((side, k), Clause((before if side == "b" else after)[k], 0.0))
    groups = {i: ([i], [j]) for i, j in pairs.items()}
    taken = set(pairs.values())
    for j in range(len(after)):
        if j not in taken:
            beside = sorted((back[k] for k in (j - 1, j + 1) if k in back), key=rank.get)
            owner = next((i for i in beside if containment(clause("a", j), clause("b", i)) >= PART), None)
            if owner is not None:
                groups[owner][1].append(j)
                taken.add(j)
    joined = set(pairs)
    for i in range(len(before)):
        if i not in joined:
            beside = sorted((k for k in (i - 1, i + 1) if k in pairs), key=rank.get)
            owner = next((k for k in beside if containment(clause("b", i), clause("a", pairs[k])) >= PART), None)
            if owner is not None:
                groups[owner][0].append(i)
                joined.add(i)
    ordered = sorted(pairs)
    still = {ordered[k] for k in increasing([pairs[i] for i in ordered])}
    labels = {new: old for i, j in pairs.items() if (new := own_label(after[j])) and (old := own_label(before[i]))}
    rows = []
    for i, (x, y) in groups.items():
        old, new = normalized(before[i]), after[pairs[i]]
        equal = old == normalized(new)
        same = equal or (bool(labels) and old == normalized(renumbered(new, labels)))
        change = "SPLIT" if len(y) > 1 else "MERGED" if len(x) > 1 else "UNCHANGED" if same else "MODIFIED"
        rows.append((float(pairs[i]), (sorted(x), sorted(y), change, round(score[i], 3), i not in still, change == "UNCHANGED" and not equal)))
    for i in range(len(before)):
        if i not in joined:
            after_it = bisect_left(ordered, i)
            rows.append(((pairs[ordered[after_it]] if after_it < len(ordered) else len(after)) - 0.5, ([i], [], "REMOVED", 0.0, False, False)))
    rows += [(float(j), ([], [j], "ADDED", 0.0, False, False)) for j in range(len(after)) if j not in taken]
    return [r for _, r in sorted(rows, key=lambda r: (r[0], r[1][0]))]


def sides(rows: list[tuple]) -> tuple[list[str], list[str]]:
    """The texts of the earlier and the later version among rows (side, text, …)."""
    return [r[1] for r in rows if r[0] == "before"], [r[1] for r in rows if r[0] == "after"]


def left_over(clauses: DataFrame) -> DataFrame:
    """pair_id, side, i, at, text of the clauses that have no equal in the other version. ``i`` counts a version's clauses, ``at`` is the
    place from 0 to 1."""

    def each(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        before, after = sides(rows)
        pairs = exact_pairs(before, after)
        for side, own, done in (("before", before, set(pairs)), ("after", after, set(pairs.values()))):
            yield from ((*key, side, i, place(i, len(own)), t) for i, t in enumerate(own) if i not in done)

    return in_groups(clauses.select("pair_id", "side", "text", "ord"), ["pair_id"], ["ord"], each, "pair_id long, side string, i int, at double, text string")


def align(clauses: DataFrame) -> DataFrame:
    """Alignments of each pair_id in ``clauses`` (pair_id, side 'before' or 'after', ord, text). A null text counts as empty."""
    clauses = clauses.select("pair_id", "side", F.coalesce("text", F.lit("")).alias("text"), "ord")
    matches = assigned(all_edges(left_over(clauses)))

    def each(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        before, after = sides(rows)
        if not before and not after:
            return
        for x, y, change, score, moved, renumbered_ in aligned(before, after, [r[3:] for r in rows if r[0] is None]):
            yield *key, x, y, change, score, moved, "\n".join(before[i] for i in x), "\n".join(after[j] for j in y), renumbered_

    # a match is a row without a side, among the clauses of its pair
    both = clauses.unionByName(matches, allowMissingColumns=True).select("pair_id", "side", "text", "ord", "i", "j", "score")
    return in_groups(both, ["pair_id"], ["ord"], each, RESULT)


TOKEN = re.compile(r"\s+|\w+(?:[.,:/]\w+)*|.", re.DOTALL)


#: Cells of a box whose choices are kept at once, a byte each.
BOX = 2**20


#: Cells of a whole table up to which plain lists are quicker than arrays.
SMALL = 2**12


def small_path(x: list[int], y: list[int]) -> np.ndarray:
    """What ``Path`` walks, from the whole table of lengths."""
    n, m = len(x), len(y)
    table = [[0] * (m + 1)]
    for a in reversed(x):
        below, row, best = table[-1], [0] * (m + 1), 0
        for j in range(m - 1, -1, -1):
            best = below[j + 1] + 1 if a == y[j] else below[j] if below[j] >= best else best
            row[j] = best
        table.append(row)
    table.reverse()
    i, j, out = 0, 0, []
    while i < n and j < m:
        kind = 0 if x[i] == y[j] else 1 if table[i + 1][j] >= table[i][j + 1] else 2
        out.append(kind)
        i, j = i + (kind != 2), j + (kind != 1)
    return np.array(out + [1] * (n - i) + [2] * (m - j), np.int8)


class Path:
    """The path through the table of common lengths of ``x`` and ``y``: a step on both sides where tokens are equal, else a deletion if that
    loses nothing, else an insertion.

    Boxes are halved until one has few cells. A sweep over a box, from its last row up, holds one row of lengths and the column in which the
    path from each cell enters the middle row; so the path's place there is known, and both halves follow. What a half must know of the
    cells below and to the right of it are one row and one column. Memory is linear in both texts.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        self.ops: list[np.ndarray] = []  # 0 both, 1 deletion, 2 insertion

    def rows(self, top: int, end: int, left: int, right: int, below: np.ndarray, edge: np.ndarray):  # noqa: ANN201
        """(row, its lengths, equal, deletion) from ``end - 1`` up to ``top``, for columns ``left`` to ``right``; ``below`` are the lengths of
        row ``end``, ``edge`` those of column ``right`` in rows ``top`` to ``end``."""
        y = self.y[left:right]
        for i in range(end - 1, top - 1, -1):
            equal = y == self.x[i]
            row = np.append(np.maximum(below[:-1], below[1:] + equal), edge[i - top])
            row = np.maximum.accumulate(row[::-1])[::-1]
            yield i, row, equal, below[:-1] >= row[1:]
            below = row

    def walk(self, top: int, end: int, left: int, right: int, below: np.ndarray, edge: np.ndarray) -> None:
        """From (top, left) to (end, right)."""
        if top == end or left == right:
            self.ops.append(np.full(right - left + end - top, 2 if top == end else 1, np.int8))
            return
        if (end - top) * (right - left) <= BOX or end - top == 1:
            kinds = np.empty((end - top, right - left), np.int8)
            for i, _, equal, deletion in self.rows(top, end, left, right, below, edge):
                kinds[i - top] = np.where(equal, 0, np.where(deletion, 1, 2))
            i, j, out = top, left, []
            while i < end and j < right:
                kind = int(kinds[i - top, j - left])
                out.append(kind)
                i, j = i + (kind != 2), j + (kind != 1)
            self.ops.append(np.array(out + [1] * (end - i) + [2] * (right - j), np.int8))
            return
        middle = (top + end) // 2
        at = np.arange(right - left + 1)
        enters, row_there = at, below
        for i, row, equal, deletion in self.rows(top, end, left, right, below, edge):
            if i >= middle:
                row_there = row
                continue
            went = np.append(np.where(equal, enters[1:], enters[:-1]), enters[-1])
            stays = np.append(equal | deletion, True)  # an insertion goes where the next column goes
            nearest = np.minimum.accumulate(np.where(stays, at, len(at))[::-1])[::-1]
            enters = went[nearest]
        cross = int(enters[0])
        side = np.empty(middle - top + 1, row_there.dtype)
        side[-1] = row_there[cross]
        for i, row, _, _ in self.rows(top, middle, left, right, row_there, edge[: middle - top + 1]):
            side[i - top] = row[cross]
        self.walk(top, middle, left, left + cross, row_there[: cross + 1], side)
        self.walk(middle, end, left + cross, right, below[cross:], edge[middle - top :])


def word_diff(a: str, b: str) -> list[tuple[str, str]]:
    """Runs of (equal | delete | insert, text) along a longest common subsequence of words; of several, the one that deletes first.
    What both texts begin with is taken off; see ``Path`` for the rest."""
    x, y = TOKEN.findall(a or ""), TOKEN.findall(b or "")
    codes: dict[str, int] = {}
    xs, ys = (np.array([codes.setdefault(t, len(codes)) for t in s], np.int64) for s in (x, y))
    short = min(len(xs), len(ys))
    differ = np.flatnonzero(xs[:short] != ys[:short])
    begun = int(differ[0]) if len(differ) else short
    n, m = len(xs) - begun, len(ys) - begun
    if n * m <= SMALL:
        walked = [small_path(xs[begun:].tolist(), ys[begun:].tolist())]
    else:
        path = Path(xs[begun:], ys[begun:])
        path.walk(0, n, 0, m, np.zeros(m + 1, np.int32), np.zeros(n + 1, np.int32))
        walked = path.ops
    ops = np.concatenate([np.zeros(begun, np.int8), *walked])
    i, j = (np.concatenate([[0], np.cumsum(ops != other)]) for other in (2, 1))
    cuts = np.flatnonzero(np.diff(ops)) + 1
    out = []
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ops)], strict=True):
        if start < end:
            kind = int(ops[start])
            out.append((("equal", "delete", "insert")[kind], "".join(y[j[start] : j[end]] if kind == 2 else x[i[start] : i[end]])))
    return out


def number_changes(runs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(before, after) of numbers that a deletion and the insertion after it change, place by place."""
    number = re.compile(r"\d+(?:[.,]\d+)*")
    out = []
    for (op, text), (next_op, next_text) in zip(runs, runs[1:], strict=False):
        if (op, next_op) == ("delete", "insert"):
            out += [(x, y) for x, y in zip(number.findall(text), number.findall(next_text), strict=False) if x != y]
    return out


def diffs(alignments: DataFrame) -> DataFrame:
    """(pair_id, before, after, runs, numbers) of aligned clauses."""
    run_type, number_type = pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())])), pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [word_diff(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            runs = pa.array([[{"op": o, "text": t} for o, t in r] for r in made], run_type)
            numbers = pa.array([[{"before": x, "after": y} for x, y in number_changes(r)] for r in made], number_type)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], runs, numbers], ["pair_id", "before", "after", "runs", "numbers"])

    slim = alignments.select("pair_id", "before", "after", "before_text", "after_text")
    return slim.mapInArrow(run, "pair_id long, before array<int>, after array<int>, runs array<struct<op:string,text:string>>, numbers array<struct<before:string,after:string>>")
