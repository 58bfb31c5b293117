"""Best-two-fit packing of token sequences.

A document's ids (a closing id included) are cut only where they exceed the capacity. The pieces of a shard, a bounded
random part of all, are packed in one task: a bin is filled greedily, always with the largest piece that fits; then its
smallest piece is taken out if two unpacked pieces fill the gap that this leaves more tightly. A shard holds many pieces
of every length, so that packing shard by shard costs at most about one part-filled sequence a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, written
from .tokens import HELD_WORDS, word_ids

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
PIECES = "piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, held_words: int = HELD_WORDS) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids (little-endian unsigned 32-bit).

    Narrow: one pass, no shuffle. A null or empty text has one piece, the closing id. Repeated rows each have their pieces.
    ``held_words`` trades memory for time; see ``tokens.word_ids``.
    """
    columns = ("piece", "start", "length", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(vocabulary, most=held_words), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [
                    (doc, i, s // 4, len(p) // 4, p)
                    for doc, text in zip(*(part.column(n).to_pylist() for n in ("doc_id", "text")), strict=True)
                    for ids in [words.of(text or "") + end]
                    for i, s in enumerate(range(0, len(ids), 4 * capacity))
                    for p in [ids[s : s + 4 * capacity]]
                ]
                kinds = (part.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", *columns])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``. Each length is from 1 to ``capacity``."""
    left: list[list[int]] = [[] for _ in range(capacity + 1)]  # positions by length
    for i in range(len(lengths) - 1, -1, -1):
        left[lengths[i]].append(i)
    present = 0  # bit n is set while a piece of length n is unpacked
    for n in range(1, capacity + 1):
        present |= bool(left[n]) << n

    def take(n: int) -> int:
        nonlocal present
        i = left[n].pop()
        if not left[n]:
            present &= ~(1 << n)
        return i

    def largest(most: int) -> int:
        return (present & ((2 << most) - 1)).bit_length() - 1 if most > 0 else 0

    bins = []
    while present:
        room, own = capacity, []
        while room and (n := largest(room)) > 0:
            own.append(take(n))
            room -= n
        if room and len(own) > 1 and present:
            small = lengths[own[-1]]
            gap = room + small
            best, first = small, largest(gap - 1)
            pair = (0, 0)
            while first > 0 and 2 * first >= best + 1:  # the larger of the two holds at least half of what they fill
                second = largest(min(first, gap - first))
                if second == first and len(left[first]) < 2:
                    second = largest(first - 1)
                if second > 0 and first + second > best:
                    best, pair = first + second, (first, second)
                    if best == gap:
                        break
                first = largest(first - 1)
            if pair[0]:
                back = own.pop()
                own += [take(pair[0]), take(pair[1])]
                left[small].append(back)
                present |= 1 << small
        bins.append(own)
    return bins


def expected_pieces(docs: DataFrame, capacity: int = CAPACITY) -> int:
    """About how many pieces ``docs`` have, from their number and lengths; it only sets the number of shards."""
    n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return n + chars // (4 * capacity)


def pack(pieces: DataFrame, expected: int, capacity: int = CAPACITY, per_shard: int = 16384) -> DataFrame:
    """``pieces`` (any columns; ``length`` from 1 to ``capacity``) with sequence_id and offset, gapless from 0 in each sequence.

    The pieces are written once, numbered. Only numbers and lengths are dealt, by a hash of the number, to shards of about
    ``per_shard``: equal rows are spread like others, and no task holds what the pieces carry. Each shard is packed on its
    own, its bins numbered within the shard, and the places are joined back by number. Every row is packed, repeated ones
    too. All columns stay, whatever their names; ones called sequence_id or offset are replaced. An empty table gives an
    empty table.
    """
    rows = pieces.drop("sequence_id", "offset")
    at = free_name(rows, "piece_number")
    shards = max(1, round(expected / per_shard))
    rows = written(rows.withColumn(at, F.monotonically_increasing_id()), "pieces")

    def packed(key: tuple, shard: pa.Table) -> pa.Table:
        lengths = shard.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = key[0].as_py() << 32
        for b, own in enumerate(best_two_fit(lengths, capacity)):
            start = 0
            for i in own:
                sequence[i], offset[i], start = base + b, start, start + lengths[i]
        return pa.table({at: shard.column(at), "sequence_id": sequence, "offset": offset})

    dealt = rows.select(F.pmod(F.xxhash64(at), F.lit(shards)).cast("long").alias("shard"), at, F.col("length").cast("long").alias("length"))
    places = dealt.groupBy("shard").applyInArrow(packed, f"{at} long, sequence_id long, offset long")
    return rows.join(places, at).drop(at)


def pack_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; of the pieces' ids only the checksum is kept."""
    pieces = token_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, expected_pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
