"""Hard-negative mining with ball trees.

Rows are dealt into blocks; the task that has a block puts a ball tree over it: halves, split across the line through two far
members, down to leaves of ``LEAF`` rows. Of each ball the centre, the radius and the range of labels are known, and a row
in it has with a query q a product between q.c - |q|r and q.c + |q|r. A ball is out if those bounds miss the score window, if
its labels cannot serve, or if its upper bound lies strictly beneath the query's current k-th score. Leaves are opened in order of
their upper bounds, more at a time as the k-th score settles, and their rows get exact products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written
from .vectors import LONGEST, lengths, matrix, products, whole_numbers

LEAF = 64
CELLS = 2**21  # components of a block of rows or anchors
HELD = 2**21  # hits held before they are cut to the k best of each query
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256.0
FOUND = "anchor long, slot int, id long, key long, score long"


class BallTree:
    """A tree over the rows of ``x``. Level l has 2**l balls; ball i of it covers the i-th of 2**l even runs of ``order``."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        n, f = len(x), x.astype(np.float64)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        self.order = np.arange(n)
        self.cuts = [np.linspace(0, n, 2**level + 1).astype(np.int64) for level in range(self.depth + 1)]
        self.centre, self.radius, self.labels = [], [], []
        for level, cuts in enumerate(self.cuts):
            balls = []
            for i in range(2**level):
                own = self.order[cuts[i] : cuts[i + 1]]
                part = f[own]
                centre = part.mean(axis=0)
                away = lengths(part - centre)
                balls.append((centre, away.max() * (1 + 1e-9), labels[own].min(), labels[own].max()))
                if level < self.depth:
                    one = part[away.argmax()]
                    other = part[lengths(part - one).argmax()]
                    half = self.cuts[level + 1][2 * i + 1] - cuts[i]
                    self.order[cuts[i] : cuts[i + 1]] = own[np.argpartition(part @ (one - other), half)]
            centres, radii, least, most = zip(*balls, strict=True)
            self.centre.append(np.array(centres))
            self.radius.append(np.array(radii))
            self.labels.append((np.array(least), np.array(most)))


class Searches:
    """Searches of one block: unit u looks for the ``k`` best rows for query ``of[u]`` with a score from ``low[u]`` to ``high[u]``, with
    the query's label (``same``) or any other."""

    def __init__(self, q: np.ndarray, labels: np.ndarray, keys: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.q, self.labels, self.keys, self.of, self.low, self.high, self.k, self.same = q, labels, keys, of, low, high, k, same
        self.norm = lengths(q)
        self.hits = [np.zeros(0, np.int64) for _ in range(4)]  # unit, score, id, key
        self.waiting: list[tuple] = []
        self.count = 0
        self.floor, self.floor_id = np.full(len(of), -LONGEST - 1), np.full(len(of), LONGEST)
        self.full = np.zeros(len(of), bool)
        self.opened = 0  # products computed so far

    def settle(self) -> None:
        """Cuts the hits to the k best of each unit and raises the floors."""
        if not self.waiting:
            return
        u, score, ids, key = (np.concatenate(c) for c in zip(self.hits, *self.waiting, strict=True))
        order = np.lexsort((key, ids, ~score, u))
        u = u[order]
        first = np.searchsorted(u, u)
        place = np.arange(len(u)) - first
        kept = place < self.k
        self.hits = [u[kept], *(c[order][kept] for c in (score, ids, key))]
        last = np.flatnonzero(place[kept] == self.k - 1)
        at = self.hits[0][last]
        self.floor[at], self.floor_id[at], self.full[at] = self.hits[1][last], self.hits[2][last], True
        self.waiting, self.count = [], 0

    def bounds(self, tree: BallTree, level: int, balls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of every query and ball; the slack outweighs the rounding of doubles."""
        c, r = tree.centre[level][balls], tree.radius[level][balls]
        middle = self.q.astype(np.float64) @ c.T
        reach = self.norm[:, None] * r[None, :]
        slack = 1 + 1e-9 * (self.norm[:, None] * (lengths(c) + r)[None, :])
        return middle - reach - slack, middle + reach + slack

    def alive(self, tree: BallTree, level: int, balls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit x ball: may it hold a result, the upper bounds of the queries)."""
        lower, upper = self.bounds(tree, level, balls)
        least, most = (side[balls] for side in tree.labels[level])
        own = self.labels[:, None]
        fits = (least <= own) & (own <= most) if self.same else ~((least == own) & (most == own))
        return fits[self.of] & (upper[self.of] >= np.maximum(self.low, self.floor)[:, None]) & (lower[self.of] <= self.high[:, None]), upper

    def descend(self, tree: BallTree, greedy: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(unit x leaf: alive, upper bounds query x leaf); ``greedy`` follows only the best ball of each unit."""
        balls = np.zeros(1, np.int64)
        alive, upper = self.alive(tree, 0, balls)
        for level in range(1, tree.depth + 1):
            some = alive.any(axis=0)
            parents, balls = alive[:, some], (2 * balls[some][:, None] + np.arange(2)[None, :]).ravel()
            alive, upper = self.alive(tree, level, balls)
            alive &= np.repeat(parents, 2, axis=1)
            if greedy and len(balls):
                best = np.where(alive, upper[self.of], -np.inf).argmax(axis=1)
                alive &= np.arange(len(balls))[None, :] == best[:, None]
        full_alive, full_upper = np.zeros((len(self.of), 2**tree.depth), bool), np.full((len(self.q), 2**tree.depth), -np.inf)
        full_alive[:, balls], full_upper[:, balls] = alive, upper
        return full_alive, full_upper

    def open(self, leaf: int, units: np.ndarray, tree: BallTree, x: np.ndarray, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> None:
        rows = tree.order[tree.cuts[-1][leaf] : tree.cuts[-1][leaf + 1]]
        queries, back = np.unique(self.of[units], return_inverse=True)
        p = products(self.q[queries], x[rows])
        self.opened += p.size
        usable = (keys[rows][None, :] != self.keys[queries][:, None]) & ((labels[rows][None, :] == self.labels[queries][:, None]) == self.same)
        s, ok = p[back], usable[back]
        floor = self.floor[units][:, None]
        ok &= (s >= self.low[units][:, None]) & (s <= self.high[units][:, None])
        ok &= ~self.full[units][:, None] | (s > floor) | ((s == floor) & (ids[rows][None, :] <= self.floor_id[units][:, None]))
        u, r = np.nonzero(ok)
        if len(u):
            self.waiting.append((units[u], s[u, r], ids[rows][r], keys[rows][r]))
            self.count += len(u)
            if self.count > HELD:
                self.settle()

    def run(self, x: np.ndarray, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """unit, score, id, key of the results, each unit's in order."""
        tree = BallTree(x, labels)
        done = np.zeros((len(self.of), 2**tree.depth), bool)
        first, _ = self.descend(tree, greedy=True)
        for leaf in np.flatnonzero(first.any(axis=0)):
            self.open(leaf, np.flatnonzero(first[:, leaf]), tree, x, ids, keys, labels)
        self.settle()
        done |= first
        alive, upper = self.descend(tree)
        alive &= ~done
        rank = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1)
        start, size = 0, 1
        while start < 2**tree.depth:
            now = alive & (rank[self.of] >= start) & (rank[self.of] < start + size)
            now &= upper[self.of] >= self.floor[:, None]
            for leaf in np.flatnonzero(now.any(axis=0)):
                self.open(leaf, np.flatnonzero(now[:, leaf]), tree, x, ids, keys, labels)
            self.settle()
            start, size = start + size, 2 * size
        return self.hits


def searched(rows: DataFrame, anchors: DataFrame, k: int, same: bool, query_block: int, block: int) -> DataFrame:
    """anchor (its key), slot, id, key, score of the ``k`` best for each anchor and slot. ``rows``: key, vec_id, label, v; ``anchors`` the same
    with ``low`` and ``high``, lists of equal length, a window for each slot. Blocks of anchors meet blocks of rows two by two; each gives
    at most k rows a window, of which the last step keeps k."""
    n, m = (df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("cells")).first() for df in (rows, anchors))
    # no fewer blocks than there are partitions to work on them, while they stay worth a tree
    blocks = max(-(-n.rows // block), -(-n.cells // CELLS), min(partitions(rows.sparkSession), -(-n.rows // 1024)), 1)
    groups = max(-(-m.rows // query_block), -(-m.cells // CELLS), 1)
    dealt = lambda df, count: df.withColumn("dim", F.size("v")).withColumn("own", F.pmod(F.xxhash64("key"), F.lit(count)).cast("int"))
    to_all = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("other")
    left = dealt(anchors, groups).select("dim", "key", "label", "v", "low", "high", "own", to_all(blocks)).withColumnsRenamed({"own": "a", "other": "b"})
    right = dealt(rows, blocks).select("dim", "key", "vec_id", "label", "v", "own", to_all(groups)).withColumnsRenamed({"own": "b", "other": "a"})

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        hits = [np.zeros(0, np.int64)] * 4
        keys = of = slot = np.zeros(0, np.int64)
        if a.num_rows and b.num_rows and len(low := a.column("low").combine_chunks()):
            keys, label = (a.column(c).to_numpy().astype(np.int64) for c in ("key", "label"))
            counts = low.value_lengths().to_numpy()
            of = np.repeat(np.arange(a.num_rows), counts)
            slot = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            windows = (a.column(c).combine_chunks().flatten().to_numpy() for c in ("low", "high"))
            search = Searches(matrix(a.column("v"), a.num_rows), label, keys, of, *windows, k, same)
            hits = search.run(matrix(b.column("v"), b.num_rows), *(b.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "key", "label")))
        u, score, ids, key = hits
        return pa.table({"anchor": keys[of[u]], "slot": slot[u].astype(np.int32), "id": ids, "key": key, "score": score})

    found = left.groupBy("dim", "a", "b").cogroup(right.groupBy("dim", "a", "b")).applyInArrow(pair, FOUND)
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def share(score: Column, percent: int, up: bool) -> Column:
    """The whole number at or above (``up``) or below ``percent`` of a hundredth of ``score``, exact for all longs."""
    product = score.cast("decimal(20,0)") * F.lit(percent).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)")
    return (F.ceil(product) if up else F.floor(product)).cast("long")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, query_block: int = 4096, block: int = 16384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``rows``: vec_id, label, v (longs), without nulls.

    An anchor's positives are its ``positives`` best other rows of its label, the negatives of each the ``negatives`` best rows of
    other labels whose score lies from ``low`` to ``high`` hundredths of the positive's; higher scores first, ties to the smaller
    vec_id. Rows are told apart by a number, so rows of one vec_id, or equal in all, are rows of their own, each an anchor by itself; of
    rows that tie in vec_id too, either may come first. Only vectors of one length meet. Scores beyond a long stop at its end. An anchor
    without positives, or a positive without negatives in its window, gives no row.
    """
    known = written(rows.select("vec_id", F.col("label").cast("long").alias("label"), "v", is_anchor.alias("is_anchor")).withColumn("key", F.monotonically_increasing_id()), "labelled")
    anchors = known.where("is_anchor")
    ends = lambda value: F.array(F.lit(value).cast("long"))
    near = searched(known, anchors.select("key", "label", "v", ends(-LONGEST - 1).alias("low"), ends(LONGEST).alias("high")), positives, True, query_block, block)
    near = written(near.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # at most ``positives`` windows an anchor
    listed = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", share(F.col("positive_score"), low, True).alias("low"), share(F.col("positive_score"), high, False).alias("high")))).alias("w"))
    windows = anchors.join(listed.withColumnRenamed("anchor", "key"), "key").select("key", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    windows = written(windows, "windows")
    hard = searched(known, windows, negatives, False, query_block, block)
    names = anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    hard = hard.withColumn("place", F.col("slot") + 1)
    return hard.join(near, ["anchor", "place"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def embedding_negatives(embeddings: DataFrame, every: int = 100, scale: float = SCALE) -> DataFrame:
    """The contract's rows: anchors are the rows whose vec_id is divisible by ``every``; a row whose vec_id is divisible by 7 counts under the
    next label. Rows with a null vec_id, label or vector, or a component that is null or not finite, take no part."""
    usable = whole_numbers(embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select("vec_id", "label", "embedding"), scale)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable.withColumn("label", label), F.col("vec_id") % every == 0)
