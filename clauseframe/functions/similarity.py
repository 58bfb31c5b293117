"""Likeness of sets, multisets and vectors, and joins that find like pairs through what they share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.streams import small
from ..session import settled


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with the vector scaled to length one, as doubles, so that a pair costs one product."""
    size = F.sqrt(dot(F.col(vector), F.col(vector)))
    return df.withColumn("_n", size).withColumn(vector, F.transform(vector, lambda x: F.when(F.col("_n") > 0, x.cast("double") / F.col("_n")).otherwise(0.0))).drop("_n")


def multiset_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, grams: str) -> DataFrame:
    """(left_key, right_key, shared, n_left, n_right): Σ of the smaller counts over shared members, and both sizes.

    An inverted index: only pairs that share a member meet, and counts are summed before the join.
    """

    def counted(df: DataFrame, key: str, name: str) -> DataFrame:
        n = df.select(key, F.size(grams).alias(f"n_{name}"), F.explode(grams).alias("gram"))
        return n.groupBy(key, f"n_{name}", "gram").agg(F.count(F.lit(1)).alias(f"c_{name}"))

    joined = counted(left, left_key, "left").join(counted(right, right_key, "right"), "gram")
    return joined.groupBy(left_key, right_key, "n_left", "n_right").agg(F.sum(F.least("c_left", "c_right")).alias("shared"))


Bag = Callable[[str], tuple[np.ndarray, np.ndarray]]
_SPACE = dict.fromkeys(map(ord, " \t\n\x0b\f\r"), None)


def trigram_bag() -> Bag:
    """The members and counts of ``text.trigrams``, each as its three code points in one number."""

    def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer(text.translate(_SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)

    return bag


def word_bag(least: int = 2) -> Bag:
    """The distinct words of ``least`` characters or more, as numbers that hold inside one task; each counts once."""
    codes: dict[str, int] = {}

    def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        own = {codes.setdefault(w, len(codes)) for w in re.split(r"[ \t\n\x0b\f\r]+", text) if len(w) >= least}
        return np.sort(np.fromiter(own, np.int64, len(own))), np.ones(len(own), np.int64)

    return bag


def bag_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str, make: Callable[[], Bag], chars: int = 4_000_000, right_chars: int = 200_000, right_rows: int = 128, left_rows: int = 4096) -> DataFrame:
    """What ``multiset_overlap`` gives, for a long ``left`` and a short ``right`` side, from their texts.

    Each text of ``left`` is read and counted once a block of ``right``, and meets that block as a table of counts; no row is
    made for a member, so one that all texts share costs what a rare one does. The number of blocks of either side follows its
    texts' length and their number, so a block's results are bounded too.
    """
    size = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).first()
    n, m = size(left), size(right)
    rows, cols = max(1, -(-n.chars // chars), -(-n.n // left_rows)), max(1, -(-m.chars // right_chars), -(-m.n // right_rows))
    kinds = {f.name: f.dataType.simpleString() for f in (left.schema[left_key], right.schema[right_key])}

    def dealt(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("int").alias(own)
        return df.select(key, F.coalesce(text, F.lit("")).alias("text"), block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)).groupBy("lb", "rb")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        own, other, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((3, 0), np.int64)]
        if a.num_rows and b.num_rows:
            bag = make()
            bags = [bag(t) for t in b.column("text").to_pylist()]
            known = np.unique(np.concatenate([x for x, _ in bags]))
            counts = np.zeros((len(known), len(bags)), np.int32)
            for j, (members, c) in enumerate(bags):
                counts[np.searchsorted(known, members), j] = c
            sizes = np.array([int(c.sum()) for _, c in bags], np.int64)
            for i, t in enumerate(a.column("text")):
                members, c = bag(t.as_py())
                at = np.searchsorted(known, members)
                hit = np.flatnonzero(at < len(known))
                hit = hit[known[at[hit]] == members[hit]]
                shared = np.minimum(counts[at[hit]], c[hit, None]).sum(axis=0)
                j = np.flatnonzero(shared)
                own.append(np.full(len(j), i))
                other.append(j)
                numbers.append(np.stack([shared[j], np.full(len(j), c.sum()), sizes[j]]).astype(np.int64))
        shared, n_left, n_right = np.concatenate(numbers, axis=1)
        keys = [side.column(key).take(pa.array(np.concatenate(at))) for side, key, at in ((a, left_key, own), (b, right_key, other))]
        return pa.table([*keys, pa.array(shared), pa.array(n_left), pa.array(n_right)], names=[left_key, right_key, "shared", "n_left", "n_right"])

    schema = f"`{left_key}` {kinds[left_key]}, `{right_key}` {kinds[right_key]}, shared long, n_left long, n_right long"
    return dealt(left, left_key, "lb", rows, "rb", cols).cogroup(dealt(right, right_key, "rb", cols, "lb", rows)).applyInArrow(meet, schema)


def weighted_terms(terms: DataFrame, group: str, part: str, term: str) -> DataFrame:
    """(group, part, term, df, w): tf * ln((1 + N) / (1 + df)) of each term that weighs something, scaled so that a part's vector has
    length one. ``terms`` has a row for each occurrence; N parts make up a group, df of them hold the term."""
    tf = terms.groupBy(group, part, term).agg(F.count(F.lit(1)).alias("tf"))
    parts = terms.groupBy(group).agg(F.countDistinct(part).alias("parts"))
    weighted = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy(group, term))).join(parts.hint("merge"), group)
    weighted = weighted.withColumn("w", F.col("tf") * F.log((1 + F.col("parts")) / (1 + F.col("df")))).where("w > 0")
    return weighted.select(group, part, term, "df", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group, part)))).alias("w"))


def threshold_candidates(scaled: DataFrame, group: str, part: str, term: str, least: float) -> DataFrame:
    """(group, part_a, part_b), part_a < part_b: all pairs whose product can reach ``least``, and some others.

    Terms are ordered from rare to common. What a part's terms from some place on weigh together bounds what they can add to any
    product. So a pair that reaches ``least`` shares a term before the place where either's rest falls short of it: only those first
    terms meet, and a pair stays if what they add up to, and the heavier of both rests, reach it.
    """
    whole, square = Window.partitionBy(group, part), F.col("w") * F.col("w")
    rest = F.sqrt(F.sum(square).over(whole.orderBy(F.desc("df"), F.desc(term))))
    left = F.coalesce(F.sqrt(F.sum(F.when(F.col("rest") < least - 1e-9, square)).over(whole)), F.lit(0.0))
    first = scaled.withColumn("rest", rest).withColumn("left", left).where(F.col("rest") >= least - 1e-9)
    side = lambda x: first.select(group, term, F.col(part).alias(f"part_{x}"), F.col("w").alias(f"w_{x}"), F.col("left").alias(f"left_{x}"))
    met = side("a").join(side("b").hint("merge"), [group, term]).where("part_a < part_b").groupBy(group, "part_a", "part_b")
    sums = met.agg(F.sum(F.col("w_a") * F.col("w_b")).alias("so_far"), F.max(F.greatest("left_a", "left_b")).alias("left"))
    return sums.where(F.col("so_far") + F.col("left") >= least - 1e-9).select(group, "part_a", "part_b")


def tfidf_pairs(terms: DataFrame, group: str, part: str, term: str, least: float) -> DataFrame:
    """(group, part_a, part_b, score): cosine of tf * ln((1 + N) / (1 + df)) of two parts of one group, from ``least`` on, which is above 0.

    ``terms`` has a row for each occurrence. Only the pairs of ``threshold_candidates`` meet and get their whole product; no pair crosses
    groups.
    """
    scaled = settled(weighted_terms(terms, group, part, term))
    near = threshold_candidates(scaled, group, part, term, least)
    side = lambda x: scaled.select(group, term, F.col(part).alias(f"part_{x}"), F.col("w").alias(f"w_{x}"))
    met = near.join(side("a").hint("merge"), [group, "part_a"]).join(side("b").hint("merge"), [group, "part_b", term])
    return met.groupBy(group, "part_a", "part_b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("score")).where(F.col("score") >= least)


#: Size of a group, in what its parts are measured by, up to which one task weighs its terms.
MOST_IN_TASK = 1_000_000
#: Products that a task holds at once, unless one part alone makes more.
PRODUCTS = 500_000


def products(table: pa.Table, least: float, held: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, score) of the pairs of parts in ``table``, whose columns are group, part and the part's terms, sorted by the first two and
    of whole groups: the weights of ``weighted_terms`` and their products, over all groups of the table at once."""
    codes = lambda c: c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    group, part, lists = (c.combine_chunks() for c in table.columns)
    said = pc.list_flatten(lists)
    if not len(said):
        return
    group, part = codes(group), codes(part)
    begins = np.append(True, (group[1:] != group[:-1]) | (part[1:] != part[:-1]))
    rows, place = np.flatnonzero(begins), np.cumsum(begins) - 1
    of, known = group[rows], part[rows] >= 0
    at, term = place[pc.list_parent_indices(lists).to_numpy()], codes(said)
    n, m = len(rows), int(term.max()) + 1
    once, tf = np.unique(at * m + term, return_counts=True)
    at, term = once // m, once % m
    _, term, df = np.unique(of[at] * m + term, return_inverse=True, return_counts=True)
    parts = np.bincount(of, known & (np.bincount(at, minlength=n) > 0))
    w = tf * np.log((1 + parts[of[at]]) / (1 + df[term]))
    at, term, w = at[w > 0], term[w > 0], w[w > 0]
    w /= np.sqrt(np.bincount(at, w * w, n))[at]
    # the parts of a term stand together, in order; each meets those behind it
    order = np.lexsort((at, term))
    order = order[known[at[order]]]
    at, term, w = at[order], term[order], w[order]
    behind = np.searchsorted(term, term, side="right") - np.arange(len(term)) - 1
    own = np.argsort(at, kind="stable")
    own = own[behind[own] > 0]
    # all products of a part are in one piece
    ends = np.append(np.flatnonzero(np.diff(at[own])), len(own) - 1) + 1 if len(own) else np.zeros(0, np.int64)
    made, start = np.append(0, np.cumsum(behind[own])), 0
    while start < len(own):
        end = max(ends[np.searchsorted(ends, start, side="right")], ends[max(0, np.searchsorted(made[ends], made[start] + held, side="right") - 1)])
        piece = own[start:end]
        i = np.repeat(piece, behind[piece])
        j = i + 1 + np.arange(len(i)) - np.repeat(made[start:end] - made[start], behind[piece])
        pairs, which = np.unique(at[i] * n + at[j], return_inverse=True)
        score = np.bincount(which, w[i] * w[j])
        near = score >= least
        yield rows[pairs[near] // n], rows[pairs[near] % n], score[near]
        start = end


def part_pairs(parts: DataFrame, group: str, part: str, terms: Column, size: Column, least: float, most: int = MOST_IN_TASK) -> DataFrame:
    """What ``tfidf_pairs`` gives of ``terms``, an array of all terms of a row of ``parts``, a name for each kind of part.

    The rows travel once, by their group, before their terms are read; a task holds one group, or about a megabyte of small ones. Groups
    whose rows have more than ``most`` in ``size`` together are left to ``tfidf_pairs``, which deals a group's terms and pairs over all tasks.
    """
    own = parts.where(F.col(group).isNotNull())
    large = own.groupBy(group).agg(F.sum(size).alias("_size")).where(F.col("_size") > most).select(group)
    some = not large.isEmpty()
    large = settled(large) if some else large
    few = own.join(large, group, "left_anti") if some else own
    kinds = ", ".join(f"`{n}` {parts.schema[c].dataType.simpleString()}" for n, c in ((group, group), ("part_a", part), ("part_b", part)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[list[pa.RecordBatch]]:
            held: list[pa.RecordBatch] = []
            for b in small(batches):
                if b.num_rows:
                    if held and held[-1].column(0)[-1] != b.column(0)[0]:
                        yield held
                        held = []
                    last = b.column(0).dictionary_encode().indices.to_numpy()
                    cut = int(np.argmax(last == last[-1]))
                    if cut:
                        yield [*held, b.slice(0, cut)]
                        held = []
                    held.append(b.slice(cut))
            yield held

        for held in whole():
            if held:
                table = pa.Table.from_batches(held)
                for a, b, score in products(table, least):
                    sides = [table.column(k).take(pa.array(x)).combine_chunks() for k, x in ((0, a), (1, a), (1, b))]
                    yield pa.RecordBatch.from_arrays([*sides, pa.array(score)], [group, "part_a", "part_b", "score"])

    dealt = few.repartition(group).sortWithinPartitions(group, part).select(group, part, terms.alias("_terms"))
    found = dealt.mapInArrow(run, f"{kinds}, score double")
    if not some:
        return found
    rest = own.join(large, group, "left_semi").select(group, part, F.explode(terms).alias("_term"))
    return found.unionByName(tfidf_pairs(rest, group, part, "_term", least))


def dealt_pairs(queries: DataFrame, vectors: DataFrame, key: str, vector: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (query, q) and (key, vector) with the columns qb and vb, so that each query meets each vector under one (qb, vb).

    The number of blocks follows from the row counts: one (qb, vb) holds about ``rows`` of either side at any size.
    """
    n_q, n_v = (max(1, -(-df.count() // rows)) for df in (queries, vectors))
    block = lambda own, n: F.pmod(F.xxhash64(*own), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("q")).withColumn("qb", block(("query", "q"), n_q)).withColumn("vb", every(n_v))
    v = vectors.select(key, vector).withColumn("vb", block((key, vector), n_v)).withColumn("qb", every(n_q))
    return q, v


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of one length as rows, and which of them hold a null."""
    flat = column.combine_chunks().flatten()
    shape = (len(column), -1) if len(flat) else (len(column), 0)
    return flat.to_numpy(zero_copy_only=False).reshape(shape), flat.is_null().to_numpy(zero_copy_only=False).reshape(shape).any(axis=1)


def best_of(k: int, key: str, vector: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of queries (query, q) and one of vectors (key, vector) -> query, key, score of the ``k`` best of each query in the block."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            (x, x_null), (y, y_null) = matrix(a.column("q")), matrix(b.column(vector))
            ids = b.column(key).to_numpy()
            for i, own in enumerate(a.column("query").to_pylist()):
                score = np.round(y @ x[i], 9)
                gone = y_null | x_null[i]
                height = np.where(gone, -np.inf, np.where(np.isnan(score), np.inf, score))
                others = np.flatnonzero(ids != own)
                if len(others) > k:
                    others = others[height[others] >= np.partition(height[others], -k)[-k]]
                for j in others[np.lexsort((ids[others], -height[others]))[:k]].tolist():
                    out[0].append(own)
                    out[1].append(int(ids[j]))
                    out[2].append(None if gone[j] else float(score[j]))
        return pa.table({"query": pa.array(out[0], pa.int64()), key: pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return best


#: Vectors that others are dealt by, at most.
PIVOTS = 256


def celled(df: DataFrame, key: str, vector: str, pivots: dict[int, tuple[list[int], np.ndarray]], rows: int) -> DataFrame:
    """(key, vector, dim, pivot, sub, angle): each vector's nearest pivot of its length, how far off it is, and its block of about ``rows``
    among the pivot's vectors. A vector without direction, or without a pivot, has the angle pi, so no bound concerns it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, angle = np.full(b.num_rows, -1, np.int32), np.full(b.num_rows, np.pi)
            sizes = b.column("dim").to_numpy()
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x, null = matrix(pa.chunked_array([b.column(vector).take(pa.array(own))]))
                if dim in shared.value and x.shape[1]:
                    numbers, p = shared.value[dim]
                    turned = (~null) & (np.abs(np.einsum("ij,ij->i", x, x) - 1) < 1e-6)
                    cos = x[turned] @ p.T
                    number[own[turned]] = np.array(numbers)[cos.argmax(axis=1)]
                    angle[own[turned]] = np.arccos(np.clip(cos.max(axis=1), -1, 1)) + 1e-6
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(vector), b.column("dim"), pa.array(number), pa.array(angle)], [key, vector, "dim", "pivot", "angle"])

    placed = df.select(key, vector, F.size(vector).alias("dim")).mapInArrow(run, f"`{key}` long, `{vector}` array<double>, dim int, pivot int, angle double")
    blocks = placed.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / rows).alias("blocks"))
    return placed.join(blocks, ["dim", "pivot"]).withColumn("sub", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")


def near_blocks(q: DataFrame, v: DataFrame, pivots: dict[int, tuple[list[int], np.ndarray]], key: str, vector: str, k: int) -> DataFrame:
    """(dim, qp, qs, vp, vs): the pairs of blocks of queries and vectors, both from ``celled``, that can hold one of a query's ``k`` best.

    A block lies within its largest angle of its pivot, so no product of two blocks exceeds the cosine of the angle between their pivots
    less both; that has to reach the least of the queries' k-th scores in one block of their own cell.
    """
    spark = q.sparkSession
    own = q.select("dim", F.col("pivot").alias("qp"), F.col("sub").alias("qs")).distinct().withColumn("vp", F.col("qp")).withColumn("vs", F.lit(0))
    tried = paired(q, v, own, key, vector, k).groupBy("query").agg(F.count("score").alias("n"), F.min("score").alias("kth"))
    # a score that is not a number sorts above all, so it bounds nothing
    floor = F.when((F.col("n") == k) & ~F.isnan("kth"), F.col("kth")).otherwise(-2.0)
    floors = q.join(tried.select(F.col("query").alias(key), floor.alias("floor")), key, "left")
    stats = floors.groupBy("dim", F.col("pivot").alias("qp"), F.col("sub").alias("qs")).agg(F.max("angle").alias("rq"), F.min(F.coalesce("floor", F.lit(-2.0))).alias("floor"))
    angles = [(-1, -1, 0.0)]
    for numbers, p in pivots.values():
        apart = np.arccos(np.clip(p @ p.T, -1, 1))
        angles += [(i, j, float(apart[a, b])) for a, i in enumerate(numbers) for b, j in enumerate(numbers)]
        angles += [(i, -1, 0.0) for i in numbers] + [(-1, i, 0.0) for i in numbers]
    between = spark.createDataFrame(angles, "qp int, vp int, apart double")  # PIVOTS squared at most
    held = v.groupBy("dim", F.col("pivot").alias("vp"), F.col("sub").alias("vs")).agg(F.max("angle").alias("rv"))
    most = F.cos(F.greatest(F.lit(0.0), F.least(F.lit(np.pi), F.col("apart") - F.col("rq") - F.col("rv"))))
    return stats.join(between, "qp").join(held, ["dim", "vp"]).where(most + 1e-8 >= F.col("floor")).select("dim", "qp", "qs", "vp", "vs")


def paired(q: DataFrame, v: DataFrame, pairs: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, score): the ``k`` best of each query in each block of vectors that ``pairs`` lets it meet."""
    names = ["dim", "qp", "qs", "vp", "vs"]
    left = q.select(F.col(key).alias("query"), F.col(vector).alias("q"), "dim", F.col("pivot").alias("qp"), F.col("sub").alias("qs")).join(pairs, names[:3])
    right = v.select(key, vector, "dim", F.col("pivot").alias("vp"), F.col("sub").alias("vs")).join(pairs, ["dim", "vp", "vs"])
    return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(best_of(k, key, vector), f"query long, `{key}` long, score double")


def pivots_of(vectors: DataFrame, key: str, vector: str, most: int = PIVOTS) -> dict[int, tuple[list[int], np.ndarray]]:
    """length -> (numbers, vectors) of at most ``most`` vectors of length one, by a hash."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    rows = vectors.where(F.abs(square - 1) < 1e-6).orderBy(F.xxhash64(key, vector), key).select(vector).limit(most).collect()
    out: dict[int, tuple[list[int], list]] = {}
    for n, r in enumerate(rows):
        numbers, found = out.setdefault(len(r[vector]), ([], []))
        numbers.append(n)
        found.append(r[vector])
    return {d: (numbers, np.array(found)) for d, (numbers, found) in out.items()}


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, rows: int = 2048) -> DataFrame:
    """(query, rank, key, score): the ``k`` vectors of the highest cosine, ties to the smaller key (a long); a key is not its own neighbour.

    Vectors of one length meet block by block; each pair of blocks gives its best ``k`` a query before anything is merged. Tables of
    more than one block are dealt around pivots, and pairs of blocks that lie too far apart to matter do not meet, see
    ``near_blocks``. A null vector takes no part; a score with a null component is null and comes last.
    """
    usable = lambda df: unit(df.select(key, vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull()), vector)
    few = vectors.limit(rows + 1).count() <= rows
    if few:
        q, v = dealt_pairs(usable(queries), usable(vectors), key, vector, rows)
        on = lambda df, x: df.withColumn("dim", F.size(x)).groupBy("dim", "qb", "vb")
        found = on(q, "q").cogroup(on(v, vector)).applyInArrow(best_of(k, key, vector), f"query long, `{key}` long, score double")
    else:
        known = usable(vectors)
        pivots = pivots_of(known, key, vector)
        q, v = (settled(celled(df, key, vector, pivots, rows)) for df in (usable(queries), known))
        found = paired(q, v, settled(near_blocks(q, v, pivots, key, vector, k)), key, vector, k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col(key)))).where(F.col("rank") <= k)
    return ranked.select("query", "rank", key, "score")


def linked(vectors: DataFrame, group: str, key: str, vector: str, least: float, counts: bool = False, rows: int = 2048) -> DataFrame:
    """Pairs of one group whose cosine is ``least`` or more: (a, b, score) with a < b, or, with ``counts``, (key, n_links) for each key
    that has a link, so that no pair is written.

    A group is dealt to blocks of about ``rows``, whose number follows its own count, and its blocks meet two by two: a group that
    holds a third of all rows is many tasks' work. Keys are longs and distinct. Rows whose group, key or vector is null, and vectors with a
    null component or of another length, have no links.
    """
    usable = unit(vectors.select(group, key, vector).where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull()), vector)
    sizes = usable.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_blocks"))
    dealt = usable.join(sizes, group).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks").cast("long")).cast("int")).withColumn("_dim", F.size(vector))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select(group, "_dim", F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y"), "_own", key, vector)

    def meet(names: tuple, block: pa.Table) -> pa.Table:
        own, ids = block.column("_own").to_numpy(), block.column(key).to_numpy()
        (v, null), (first, second) = matrix(block.column(vector)), (names[2].as_py(), names[3].as_py())
        left, right = np.flatnonzero((own == first) & ~null), np.flatnonzero((own == second) & ~null)
        a, b, score, n = [], [], [], np.zeros(len(ids), np.int64)
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            s = v[part] @ v[right].T
            hit = (s >= least) | np.isnan(s)
            if first == second:
                hit &= ids[part][:, None] < ids[right][None, :]
            i, j = np.nonzero(hit)
            if counts:
                np.add.at(n, part[i], 1)
                np.add.at(n, right[j], 1)
            else:
                x, y = ids[part[i]], ids[right[j]]
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
                score.append(s[i, j])
        if counts:
            return pa.table({key: ids[n > 0], "n_links": n[n > 0]})
        joined = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"a": joined(a, pa.int64()), "b": joined(b, pa.int64()), "score": joined(score, pa.float64())})

    schema = f"`{key}` long, n_links long" if counts else "a long, b long, score double"
    found = met.groupBy(group, "_dim", "_x", "_y").applyInArrow(meet, schema)
    return found.groupBy(key).agg(F.sum("n_links").alias("n_links")) if counts else found
