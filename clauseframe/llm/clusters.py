"""Centroid clustering with block-norm screening.

A vector is compressed to the norms of its segments, those of its positive and its negative components apart, made once. By
Cauchy and Schwarz, and since components of unlike signs only lessen it, the inner product of a vector and a centroid is at most
the inner product of those norms, so the squared distance is at least

    |x|^2 + |c|^2 - 2 * sum over segments of |x+_s| * |c+_s| + |x-_s| * |c-_s|

which is found for all centroids at once, then again with the first half, then three quarters, of the segments resolved. A centroid whose
bound lies above the best exact distance so far is out; the others get exact integer distances. Assignments, sums and centroids
are whole numbers throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .vectors import LONGEST, lengths, matrix, squared_distances, whole_numbers

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256.0, "2"
SEGMENTS = 16
RESOLVED = (0, 8, 12)  # segments whose products are computed rather than bounded, level by level
SUM = pa.decimal128(38, 0)


def block_norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """(rows, segments, 2): the norm of the positive and of the negative components of each segment, a little too long rather than
    too short. Segments are of one length, or of no more than one component if they are short of that."""
    width = -(-x.shape[1] // segments)
    x = np.pad(x.astype(np.float64), ((0, 0), (0, width * segments - x.shape[1]))).reshape(len(x), segments, width)
    return np.stack([lengths(np.maximum(x, 0)), lengths(np.minimum(x, 0))], axis=-1) * (1 + 1e-12)


class Centroids:
    """The centroids of one round with their block norms; ``nearest`` assigns a block of vectors."""

    def __init__(self, numbers: np.ndarray, resolved: tuple[int, ...] = RESOLVED):
        self.numbers, self.resolved = numbers, resolved
        self.width = -(-numbers.shape[1] // SEGMENTS)
        self.square = lengths(numbers) ** 2
        self.norms = block_norms(numbers)
        self.exact = 0  # distances computed so far

    def bounds(self, x: np.ndarray, norms: np.ndarray) -> Iterator[np.ndarray]:
        """Lower bounds of all distances, level by level; the slack outweighs the rounding of doubles."""
        both = (lengths(x) ** 2)[:, None] + self.square[None, :]
        norms = norms.reshape(len(x), SEGMENTS, 2)
        for s in self.resolved:
            most = norms[:, s:].reshape(len(x), -1) @ self.norms[:, s:].reshape(len(self.numbers), -1).T
            if s:
                most += x[:, : s * self.width].astype(np.float64) @ self.numbers[:, : s * self.width].T.astype(np.float64)
            yield both - 2 * most - 1e-9 * both - 1

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row, ties to the smaller number."""
        n, k = len(x), len(self.numbers)
        bound = np.full((n, k), -np.inf)
        best, at = np.full(n, LONGEST, np.int64), np.full(n, k, np.int64)
        for level in self.bounds(x, norms):
            np.maximum(bound, level, out=bound)
            # the most promising centroid of this level first, so that the next level has something to prune against
            first = bound.argmin(axis=1)
            for j in np.unique(first):
                self.meet(x, j, np.flatnonzero(first == j), best, at)
        for j in range(k):
            self.meet(x, j, np.flatnonzero((bound[:, j] <= best) & (at != j)), best, at)
        over = np.flatnonzero(best == LONGEST)
        for part in np.array_split(over, -(-len(over) // 256)) if len(over) else ():  # distances that a long cannot tell apart
            far = ((x[part].astype(object)[:, None] - self.numbers.astype(object)[None]) ** 2).sum(axis=2)
            at[part] = far.argmin(axis=1)
        return at, best

    def meet(self, x: np.ndarray, j: int, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        if len(rows):
            d = squared_distances(x[rows], self.numbers[j])
            self.exact += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], j


def prepared(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """vec_id, v (longs) and norms of each usable vector, written once for all rounds."""
    rows = whole_numbers(embeddings.select("vec_id", "embedding"), scale).where(F.size("v") == dimensions)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                norms = block_norms(matrix(b.column("v"), b.num_rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, norms.size + 1, 2 * SEGMENTS), pa.int32()), pa.array(norms.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], ["vec_id", "v", "norms"])

    return written(rows.mapInArrow(compressed, f"vec_id {kind}, v array<long>, norms array<double>"), "vectors")


def starts(rows: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors of smallest hash of ``<seed>:<vec_id>``, in that order; of one id's vectors the smaller comes first. A vector
    without an id is no start."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where(F.col("vec_id").isNotNull()).select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centroids(centroids)
        for b in batches:
            if b.num_rows:
                at, d = now.nearest(matrix(b.column("v"), b.num_rows), matrix(b.column("norms"), b.num_rows))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v", "norms").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: the exact floor of each component's mean. A task gives one row of sums for each centroid that it meets, whatever
    the number of its vectors, and Spark adds those up."""
    d = centroids.shape[1]
    names = [f"s{i}" for i in range(d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centroids(centroids)
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), d), object)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"), b.num_rows)
                at, _ = now.nearest(x, matrix(b.column("norms"), b.num_rows))
                order = np.argsort(at, kind="stable")
                met, start = np.unique(at[order], return_index=True)
                n += np.bincount(at, minlength=len(n))
                # halves of 32 bits: a batch's sums fit a long
                for shift, half in ((0, x & (2**32 - 1)), (32, x >> 32)):
                    sums[met] += np.add.reduceat(half[order], start, axis=0).astype(object) << shift
        met = np.flatnonzero(n)
        columns = [pa.array([Decimal(int(v)) for v in sums[met, i]], SUM) for i in range(d)]
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met]), *columns], ["cluster", "n", *names])

    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), *(T.StructField(s, T.DecimalType(38, 0)) for s in names)])
    total = rows.select("v", "norms").mapInArrow(run, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names)).collect()
    out = centroids.copy()
    for r in total:  # at most one row a centroid
        out[r.cluster] = [int(r[s]) // r.n for s in names]
    return out


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: float = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of ``dimensions`` finite components.

    Vectors are written once, with their block norms, and scanned ``rounds + 1`` times; between the scans only sums of at most ``k`` rows
    a task are shuffled, so the size of a cluster does not matter. Other columns are not looked at. Repeated rows are vectors
    of their own, a null vec_id is assigned and counted but never a start. With fewer than ``k`` vectors that have an id there are
    as many centroids; without any the result is empty. Distances and their sums beyond a long stop at its end.
    """
    rows = prepared(embeddings, dimensions, scale)
    spark = rows.sparkSession
    centroids = starts(rows, k, seed)
    result = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".format(rows.schema["vec_id"].dataType.simpleString())
    if not len(centroids):
        return spark.createDataFrame([], result)
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    last = written(assigned(rows, centroids), "assigned")
    inertia = {r.cluster: int(r.d) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = min(LONGEST, sum(inertia.values()))
    facts = [(j, min(LONGEST, d), whole, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, d in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return last.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
