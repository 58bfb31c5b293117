"""Exact top-k inner-product search with segment statistics.

A vector is cut into segments; of each the mean and the deviation (root of the summed squared differences from the mean)
are kept, at several resolutions. By Cauchy and Schwarz the inner product over a segment of n components is at most
n * mean_q * mean_x + deviation_q * deviation_x, which is the same as a lower bound of the distance. The bounds tighten
from coarse to fine; a candidate whose bound falls below the query's k-th best score so far is out, and exact products are
computed for the survivors only. Nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import Rows, lengths, matrix, whole_numbers

SEGMENTS = (1, 4, 16)
TILE = 2**20  # so many bounds are held at once
DENSE = 0.1  # share of survivors from which on they are not looked up one by one
CELLS = 2**21  # components of a block of rows
SLACK = 1e-9  # of both lengths; outweighs the rounding of doubles, which bounds are made of
FOUND = "query long, key long, vec_id long, score long"


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means times root n, and deviations, of each segment: then the bound is a plain product of both halves."""
    if not x.shape[1]:
        return np.zeros((len(x), 1)), np.zeros((len(x), 1))
    parts = np.array_split(x.astype(np.float64), min(segments, x.shape[1]), axis=1)
    means = np.stack([p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts], axis=1)
    spread = np.stack([np.sqrt(((p - p.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) for p in parts], axis=1)
    return means, spread


def best(query_keys: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, segments: tuple[int, ...] = SEGMENTS, keys: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """For each query, (ids, scores) of its k best of ``x``, ties to the smaller id; the row of its own key takes no part. Keys are ids
    unless ``keys`` has them, and then they are given third."""
    order = np.argsort(ids, kind="stable")
    own_keys = ids if keys is None else keys
    ids, x, own_keys = ids[order], x[order], own_keys[order]
    levels = [(statistics(q, s), statistics(x, s)) for s in segments]
    slack, far, rows = SLACK * lengths(q), lengths(x), Rows(x)
    (qm, qs), (xm, xs) = levels[0]
    tile = max(1, TILE // max(1, len(x)))
    for start in range(0, len(q), tile):
        these = range(start, min(start + tile, len(q)))
        coarse = qm[start : start + tile] @ xm.T
        coarse += qs[start : start + tile] @ xs.T
        survivors = []
        for i in these:
            own = own_keys != query_keys[i]
            loose = slack[i] * far + 1
            bound = np.where(own, coarse[i - start] + loose, -np.inf)
            n = min(k, int(own.sum()))
            # a first floor: the exact k-th best among those of the highest coarse bound
            tops = np.argpartition(-bound, min(8 * k, len(ids)) - 1)[: 8 * k]
            tops = tops[own[tops]]
            floor = float(np.sort(rows.products(q[i : i + 1], tops)[:, 0])[-n]) if 0 < n <= len(tops) else -np.inf
            alive = np.flatnonzero((bound >= floor) & own)
            for (am, as_), (bm, bs) in levels[1:]:
                alive = alive[bm[alive] @ am[i] + bs[alive] @ as_[i] + loose[alive] >= floor]
            survivors.append(alive)
        # where few fall out, one product of all is faster than many of most
        dense = rows.products(q[start : start + tile]) if sum(map(len, survivors)) > DENSE * len(x) * len(these) else None
        for i, alive in zip(these, survivors, strict=True):
            scores = rows.products(q[i : i + 1], alive)[:, 0] if dense is None else dense[alive, i - start]
            place = np.lexsort((own_keys[alive], ids[alive], ~scores))[:k]
            kept, scores = alive[place], scores[place]
            yield (ids[kept], scores) if keys is None else (ids[kept], scores, own_keys[kept])


def search(vectors: DataFrame, queries: DataFrame, k: int, query_block: int = 4096, block: int = 16384, key: str = "vec_id") -> DataFrame:
    """The k best of ``vectors`` for each of ``queries``, both (vec_id, v array<long>): query_id, rank, vec_id, score.

    Queries meet all rows block by block: both sides are dealt into blocks by a hash of the row, each pair of blocks is one
    task's work, and gives at most k rows a query; the last step ranks what the blocks gave. The number of blocks follows
    from the counts of rows and components, so a task's memory grows neither with the tables nor with the width; of its bounds it holds
    ``TILE`` at a time. A query is compared with vectors of its own length only, of any length and with components of any size; scores
    beyond a long stop at its ends. Rows are told apart by ``key``, a long: a query's own row takes no part. Empty tables give an
    empty table.
    """
    sizes = [df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("cells")).first() for df in (vectors, queries)]
    rows, cols = (max(1, -(-s.n // size), -(-s.cells // CELLS)) for s, size in zip(sizes, (block, query_block), strict=True))
    known = lambda df: df.select("vec_id", F.col(key).alias("key"), "v", F.size("v").alias("dim"))
    dealt = lambda df, n: known(df).withColumn("block", F.pmod(F.xxhash64("key", "vec_id"), F.lit(n)).cast("int"))
    left = dealt(queries, cols).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).select("dim", F.col("block").alias("qb"), F.col("other").alias("xb"), "key", "v")
    right = dealt(vectors, rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))).select("dim", F.col("other").alias("qb"), F.col("block").alias("xb"), "key", "vec_id", "v")

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if a.num_rows and b.num_rows:
            own = a.column("key").to_numpy()
            found = best(own, matrix(a.column("v"), a.num_rows), b.column("vec_id").to_numpy(), matrix(b.column("v"), b.num_rows), k, keys=b.column("key").to_numpy())
            for one, (ids, scores, keys) in zip(own, found, strict=True):
                for column, made in zip(out, (np.full(len(ids), one), keys, ids, scores), strict=True):
                    column.append(made)
        return pa.table({n: np.concatenate(c) for n, c in zip(("query", "key", "vec_id", "score"), out, strict=True)})

    found = left.groupBy("dim", "qb", "xb").cogroup(right.groupBy("dim", "qb", "xb")).applyInArrow(pair, FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "key"))).where(F.col("rank") <= k)
    if key == "vec_id":
        return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
    names = queries.select(F.col(key).alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")


def whole(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * component) of vectors that are not null and hold only finite numbers; ids that are null take no part."""
    return whole_numbers(vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding"), scale)


def embedding_topk(embeddings: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0) -> DataFrame:
    """The contract's rows: queries are the rows whose vec_id is divisible by ``every``. Rows are numbered when they are written, so of
    several rows with one vec_id each is a row, and a query, of its own, with ``k`` rows of its own."""
    rows = written(whole(embeddings, scale).withColumn("key", F.monotonically_increasing_id()), "vectors")
    return search(rows, rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0), k, key="key")
