"""Near-duplicate groups: min-max hashing for candidates, exact set similarity for links.

A document's set are its distinct shingles of ``SHINGLE`` lower-cased words. Under each of ``PERMUTATIONS`` permutations
both the smallest and the largest element are kept, so each evaluation gives two values that agree with the probability of
the Jaccard similarity. ``BANDS`` bands of two permutations, four values, make the candidates; at the threshold of 0.75 a
pair shares none of them with probability (1 - 0.75 ** 4) ** 40, under 3e-7. Both ends of a small set agree less often
than that, so sets of at most ``SMALL`` shingles have exact keys besides: one for each subset that a link could have in common.

Pairs are never listed. Documents with one and the same set count as one. In each band's bucket, members are compared with
the first one by their signatures of 160 values; whoever is far from it (``FAR``) is compared with all members that are not
almost equal to it, block by block. So documents that share a bucket by a common passage are not put together, and a pair of
similarity 0.75 always has a path: if one of the two is almost equal to the first, the other cannot be far from it.
Candidate clusters are the components of what is left; each cluster's sets meet in tasks of bounded size, which compare
exactly and give a spanning forest of the links only. A cluster too large for one task is cut into blocks: first each block
is compared with the cluster's pivot, which leaves outliers; then outliers meet every block.

Shingles are told apart by 64 bits, mixed from the words' BLAKE2 digests: two different ones of a pair of documents with n
and m shingles agree with probability n * m / 2 ** 64, whatever the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, free_name, mixed, portions, windows, written
from .components import components

SHINGLE, PERCENT = 5, 75
PERMUTATIONS, BANDS = 80, 40
BLOCK_WORDS = 3_000_000
SMALL = 8
#: Equal signature values, of 160, below which two sets are far from each other (similarity 0.5, seven deviations under 0.75),
#: and from which they are almost equal (0.9: what is within 0.25 of it is within 0.35 of the other, three deviations from far).
FAR, ALMOST = PERMUTATIONS, 144
BUCKET_BLOCK = 4096
_SEEDS = mixed(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
XOR = (_SEEDS[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32)
MULTIPLY = (_SEEDS[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles(words: Words, text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted set; of fewer than ``size`` words, one shingle; of none, empty."""
    a, b = words.halves((text or "").encode().lower().split())
    n = min(size, len(a))
    return np.unique(windows(a, n) ^ mixed(windows(b, n))) if n else a


def signature(own: np.ndarray) -> np.ndarray:
    """The smallest and the largest value of a set that is not empty under each permutation, side by side."""
    low = mixed(own).astype(np.uint32)
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    step = max(1, 65536 // len(low))
    for at in range(0, PERMUTATIONS, step):
        part = slice(at, at + step)
        v = (low[None, :] ^ XOR[part, None]) * MULTIPLY[part, None]
        out[part, 0], out[part, 1] = v.min(axis=1), v.max(axis=1)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in values.reshape(BANDS, -1).T:
        key = mixed(key * np.uint64(0xC2B2AE3D27D4EB4F) + column)
    return key


def subset_keys(own: np.ndarray) -> np.ndarray:
    """A key for each subset of a small set that could be all it has in common with one it is linked with."""
    n, own = len(own), mixed(own ^ np.uint64(0xA0761D6478BD642F))
    least = -(-PERCENT * n // 100)
    return np.array([mixed(own[list(c)].sum(keepdims=True))[0] for size in range(least, n + 1) for c in combinations(range(n), size)], np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set (16 bytes that name the set), keys (band and subset keys) and signature (a byte of each of its
    values); none of an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, none = Words(), np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for doc, text in portions(batch, "doc_id", "text"):
                own = shingles(words, text)
                name = np.array([own.sum(), mixed(own).sum()], np.uint64).tobytes()
                values = signature(own) if len(own) else none
                keys = band_keys(values) if len(own) else none
                if 0 < len(own) <= SMALL:
                    keys = np.append(keys, subset_keys(own))
                rows.append((doc, len(own), name, keys.view(np.int64), mixed(values).astype(np.uint8).tobytes()))
            ends = np.cumsum([0, *(len(r[3]) for r in rows)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([none.view(np.int64), *(r[3] for r in rows)])))
            columns = [pa.array([r[i] for r in rows], k) for i, k in ((0, pa.int64()), (1, pa.int64()), (2, pa.binary()), (4, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns[:3], keys, columns[3]], ["doc_id", "n_shingles", "set", "keys", "signature"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_shingles long, set binary, keys array<long>, signature binary")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Signatures, a row each."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.uint8).reshape(len(data), 2 * PERMUTATIONS)


class Forest:
    """Disjoint sets over positions, the smaller root on top."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


class Postings:
    """The sets of one task, turned around: for each shingle the positions that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.all = np.concatenate(sets)
        order = np.argsort(self.all, kind="stable")
        self.all, self.at = self.all[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def similar(self, own: np.ndarray) -> np.ndarray:
        """The positions whose set has at least ``PERCENT`` hundredths of the union in common with ``own``."""
        low, high = np.searchsorted(self.all, own), np.searchsorted(self.all, own, "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        shared = np.bincount(self.at[at], minlength=len(self.sizes))
        return np.flatnonzero((shared > 0) & (100 * shared >= PERCENT * (len(own) + self.sizes - shared)))


def forest_links(ids: list[int], sets: list[np.ndarray], queries: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that connect what the exact links among ``sets`` connect: of every pair with one end in ``queries``, or
    of every pair where that is None.

    A pair need not be compared if both are in one group already. So sets that nothing has linked yet are compared with
    all first; then all others, but for the members of the largest group.
    """
    found, forest, postings = [], Forest(len(sets)), Postings(sets)

    def compare(i: int) -> None:
        for j in postings.similar(sets[i]).tolist():
            linked[j] = True
            if forest.join(i, j):
                found.append((ids[i], ids[j]))

    linked, later = [False] * len(sets), []
    for i in range(len(sets)) if queries is None else queries:
        if queries is None and linked[i]:
            later.append(i)
        else:
            compare(i)
    if later:
        roots = [forest.root(i) for i in later]
        largest = max(set(roots), key=roots.count)
        for i in later:
            if forest.root(i) != forest.root(largest):
                compare(i)
    return found


LINKS = "a long, b long"


def as_links(rows: list[tuple[int, int]]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("a", "b"))})


def exact_links(members: DataFrame) -> DataFrame:
    """Links (a, b) inside each cluster of ``members`` (cluster, doc_id, n_shingles, text), as a forest."""
    sized = members.groupBy("cluster").agg(F.sum("n_shingles").alias("words"), F.min("doc_id").alias("pivot"))
    sized = sized.select("cluster", "pivot", F.ceil(F.col("words") / BLOCK_WORDS).cast("int").alias("blocks"))
    members = written(members.join(sized, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")), "members")

    def all_pairs(part: pa.Table) -> pa.Table:
        part, words = part.sort_by("doc_id"), Words()
        return as_links(forest_links(part.column("doc_id").to_pylist(), [shingles(words, t) for t in part.column("text").to_pylist()]))

    small = members.where("blocks = 1").select("cluster", "doc_id", "text").groupBy("cluster").applyInArrow(all_pairs, LINKS)
    large = members.where("blocks > 1")
    if large.isEmpty():
        return small

    def with_pivot(part: pa.Table, pivot: pa.Table) -> pa.Table:
        if not part.num_rows or not pivot.num_rows:
            return as_links([])
        words = Words()
        linked = Postings([shingles(words, t) for t in part.column("text").to_pylist()]).similar(shingles(words, pivot.column("text")[0].as_py()))
        return as_links([(pivot.column("doc_id")[0].as_py(), part.column("doc_id")[int(i)].as_py()) for i in linked])

    pivots = large.where("doc_id = pivot").select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "doc_id", "text")
    blocks = large.select("cluster", "block", "doc_id", "text")
    starred = written(blocks.groupBy("cluster", "block").cogroup(pivots.groupBy("cluster", "block")).applyInArrow(with_pivot, LINKS), "pivots")

    def with_outliers(part: pa.Table, out: pa.Table) -> pa.Table:
        if not part.num_rows or not out.num_rows:
            return as_links([])
        words, n = Words(), out.num_rows
        ids = out.column("doc_id").to_pylist() + part.column("doc_id").to_pylist()
        sets = [shingles(words, t) for t in out.column("text").to_pylist() + part.column("text").to_pylist()]
        return as_links([(a, b) for a, b in forest_links(ids, sets, list(range(n))) if a != b])

    outliers = written(large.join(starred.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_anti").select("cluster", F.col("block").alias("dealt"), "blocks", "doc_id", "text"), "outliers")
    dealt = blocks.join(outliers.select("cluster", "dealt").distinct(), "cluster").select(F.col("cluster").alias("c"), F.col("dealt").alias("d"), F.col("block").alias("b"), "doc_id", "text")
    spread = outliers.select("cluster", "dealt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "doc_id", "text")
    last = dealt.groupBy("c", "d", "b").cogroup(spread.groupBy("cluster", "dealt", "block")).applyInArrow(with_outliers, LINKS)
    return small.unionByName(starred.where("a <> b")).unionByName(last)


def compared_with_first(keyed: DataFrame, signed: DataFrame) -> DataFrame:
    """key, doc_id, head, alike: every member of a bucket of two and more but its first, and how many values it shares with that."""
    heads = keyed.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    rows = written(keyed.join(heads, "key").where("doc_id <> head"), "buckets")
    own = signed.select("doc_id", F.col("signature").alias("own"))
    pairs = rows.select("doc_id", "head").distinct().join(own, "doc_id").join(own.select(F.col("doc_id").alias("head"), F.col("own").alias("other")), "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = (matrix(b.column("own")) == matrix(b.column("other"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("head"), pa.array(alike, pa.int64())], ["doc_id", "head", "alike"])

    alike = written(pairs.mapInArrow(run, "doc_id long, head long, alike long"), "alike")
    return written(rows.join(alike, ["doc_id", "head"]), "compared")


def residual_links(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Candidate links (a, b) in buckets where a member is far from the first one: of each such member with all members that are
    not almost equal to the first. Both sides are dealt into blocks; each pair of blocks is one task's work."""
    far = F.col("alike") < FAR
    n = rows.groupBy("key").agg(F.count_if(far).alias("n_far"), F.count_if(F.col("alike") < ALMOST).alias("n_all")).where("n_far > 0 AND n_all > 1")
    blocks = lambda c: F.ceil(F.col(c) / BUCKET_BLOCK).cast("int")
    n = n.select("key", blocks("n_far").alias("i_n"), blocks("n_all").alias("j_n"))
    left = written(rows.where(F.col("alike") < ALMOST).join(n, "key").join(signed.select("doc_id", "signature"), "doc_id"), "far")

    def dealt(side: DataFrame, own: str, other: str, mark: str) -> DataFrame:
        at = F.pmod(F.xxhash64("doc_id"), F.col(f"{own}_n")).cast("int").alias(own)
        spread = side.select("key", "doc_id", "signature", at, F.explode(F.sequence(F.lit(0), F.col(f"{other}_n") - 1)).alias(other))
        return spread.select(*(F.col(c).alias(f"{c}{mark}") for c in ("key", "i", "j")), F.col("doc_id").alias(f"doc{mark}"), F.col("signature").alias(f"signature{mark}"))

    def pair(some: pa.Table, all_: pa.Table) -> pa.Table:
        if not some.num_rows or not all_.num_rows:
            return as_links([])
        ours, theirs = some.column("doc1").to_pylist(), all_.column("doc2").to_pylist()
        place = {d: i for i, d in enumerate(sorted({*ours, *theirs}))}
        forest, out, m = Forest(len(place)), [], matrix(all_.column("signature2"))
        for doc, own in zip(ours, matrix(some.column("signature1")), strict=True):
            for j in np.flatnonzero((m == own).sum(axis=1) >= FAR).tolist():
                if forest.join(place[doc], place[theirs[j]]):
                    out.append((doc, theirs[j]))
        return as_links(out)

    some, all_ = dealt(left.where(far), "i", "j", "1"), dealt(left, "j", "i", "2")
    return some.groupBy("key1", "i1", "j1").cogroup(all_.groupBy("key2", "i2", "j2")).applyInArrow(pair, LINKS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text).

    Documents with an intersection of at least 0.75 of their union are linked; component_id is the smallest doc_id that
    links reach, kept says that the row has it. An empty set is linked with nothing. A null doc_id takes no part: its
    component_id is null and it is kept. Rows that repeat a doc_id have its component; if their texts differ, all their
    links count. Other columns are not read. An empty table gives an empty table.
    """
    signed = written(signatures(docs), "signatures")
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = usable.groupBy("set", "n_shingles").agg(F.min("doc_id").alias("rep"))
    # one row per distinct set goes into the bands, under the smallest doc_id that has it
    chosen = usable.join(first, ["set", "n_shingles"]).where("doc_id = rep").dropDuplicates(["doc_id", "set", "n_shingles"])
    # a doc_id with several texts has the signatures of all of them
    one = chosen.select("doc_id", "signature")
    met = compared_with_first(chosen.select("doc_id", F.explode("keys").alias("key")).distinct(), one)
    near = met.where(F.col("alike") >= FAR).select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    candidates = components(near.unionByName(residual_links(met, one)))
    clusters = written(candidates.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lengths = chosen.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    members = texts.join(clusters.join(lengths, "doc_id"), "doc_id")
    copies = usable.join(first, ["set", "n_shingles"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    linked = components(exact_links(members).unionByName(copies))
    found = signed.select("doc_id", "n_shingles").join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = F.coalesce("component", "doc_id").alias("component_id")
    return found.select("doc_id", "n_shingles", own).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, whatever their names, that are the first of their group; see ``near_duplicates``."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(free_name(docs, "gone"))).distinct()
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")
