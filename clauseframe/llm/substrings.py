"""Removal of repeated passages: a count-min prefilter, then exact groups of the windows it cannot rule out.

A window is ``LENGTH`` consecutive words. Rows are dealt to blocks of bounded text, and a block counts each of its distinct
windows once, whatever stands in it how often; repeats inside a block are settled there. The rest takes three steps:

1. Each block adds its windows to a count-min sketch of its own. The partial sketches travel as sorted counter positions to
   ranges of counters, are merged there, and each block is told which of its counters reached two. A counter never falls
   short, so a window whose counters did not all reach two stands in no other block.
2. Only the other windows are dealt by their hash, each with the smallest doc_id that has it in its block, and grouped
   exactly. A block is told which of its windows stand in a document of a smaller doc_id elsewhere.
3. Each block drops the words that its repeated windows cover.

The sketch has at least four counters for each window and row, at any size, and is never brought to one place: a task
holds one range of it. A window is told from others by 128 bits, made from the words' BLAKE2 digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bucketed, from_gaps, free_name, gaps, portions, schema_with, windows

LENGTH = 13
DEPTH, LOAD = 2, 4
#: About so many bytes of text make a block.
BLOCK_BYTES = 4_000_000
#: Counters of one range, as a power of two; windows of one shard; bytes of text of one bucket of the table.
RANGE_BITS, GROUP_WINDOWS, BUCKET_BYTES = 24, 1_000_000, 64_000_000


def with_block(docs: DataFrame, block: str) -> DataFrame:
    """``docs`` with the number of each row's block: rows that a task reads one after another, up to about ``BLOCK_BYTES`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if batch.num_rows:
                size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = before + np.cumsum(size)
                before = int(ends[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + (ends - size) // BLOCK_BYTES)], [*batch.schema.names, block])

    return docs.mapInArrow(run, schema_with(docs, **{block: "long"}))


class Block:
    """The distinct windows of a block's rows: their 128 bits (``a``, ``b``), ascending, and the smallest doc_id that has each.

    Rows without an id take no part. Nothing depends on the order of the rows.
    """

    def __init__(self, rows: pa.Table, length: int):
        self.length, words, halves, self.sizes, ids = length, Words(), [np.zeros((2, 0), np.uint64)], [], []
        for batch in rows.to_batches():
            for doc, text in portions(batch, "doc_id", "text"):
                own = (text or "").encode().split()
                self.sizes.append(len(own))
                ids.append(doc)
                halves.append(words.halves(own))
        halves = np.concatenate(halves, axis=1)
        sizes = np.array(self.sizes, np.int64)
        n = np.where([i is not None for i in ids], np.maximum(sizes - length + 1, 0), 0) if ids else sizes
        #: Where each window begins, counted in words of the whole block.
        self.starts = np.repeat(np.cumsum(sizes) - sizes, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.docs = np.repeat(np.array([i or 0 for i in ids], np.int64), n)
        a, b = (windows(h, length)[self.starts] if len(self.starts) else np.zeros(0, np.uint64) for h in halves)
        order = np.argsort(a)
        if (np.diff(b[order])[np.diff(a[order]) == 0] != 0).any():
            order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.order, self.of = order, np.cumsum(new) - 1
        self.a, self.b = a[first], b[first]
        self.least = np.minimum.reduceat(self.docs[order], first) if len(a) else self.docs

    def counters(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The counters of the windows in one row of the sketch, ascending, and which windows they are; equal ones in any order."""
        at = ((self.a, self.b)[row] >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(at) if row else np.arange(len(at))  # the first row's counters ascend with the windows
        return at[order], order

    def repeated(self, elsewhere: np.ndarray) -> np.ndarray:
        """For each window, in order of the text: whether it starts in a document of a smaller id, in this block or elsewhere."""
        out = np.empty(len(self.order), bool)
        out[self.order] = elsewhere[self.of] | (self.docs[self.order] > self.least[self.of])
        return out

    def covered(self, windows_: np.ndarray) -> np.ndarray:
        """For each word of the block, whether one of the chosen windows covers it."""
        edge = np.zeros(sum(self.sizes) + 1, np.int32)
        at = self.starts[windows_]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.length, -1)
        return np.cumsum(edge)[:-1] > 0


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def cut(ordered: np.ndarray) -> list[tuple[int, slice]]:
    """(value, slice) of each run of equal numbers."""
    ends = np.append(np.flatnonzero(np.diff(ordered)) + 1, len(ordered)) if len(ordered) else []
    return [(int(ordered[e - 1]), slice(s, e)) for s, e in zip([0, *ends], map(int, ends), strict=False)]


SKETCH, ANSWER = "block long, row int, part long, counters binary", "block long, row int, part long, n int, reached binary"
WINDOWS, ELSEWHERE = "block long, shard long, at binary, docs binary, a binary, b binary", "block long, at binary"


def sketch_answers(texts: DataFrame, length: int, bits: int) -> DataFrame:
    """For each block, row and range: which of the block's counters, in ascending order, reached two in the merged sketch."""
    low = min(bits, RANGE_BITS)

    def partial(rows: pa.Table) -> pa.Table:
        own, block, out = Block(rows, length), rows.column("block")[0].as_py(), []
        for row in range(DEPTH):
            at, _ = own.counters(row, bits)
            out += [(block, row, part, gaps(at[p] - (part << low))) for part, p in cut(at >> low)]
        return table_of(SKETCH, out)

    def merged(pieces: pa.Table) -> pa.Table:
        count, out = np.zeros(1 << low, np.uint8), []
        for data in pieces.column("counters"):
            at = from_gaps(data.as_py())
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            count[at[new]] = np.minimum(count[at[new]] + np.minimum(np.diff(np.append(new, len(at))), 2), 2)
        for block, row, part, data in zip(*(pieces.column(n) for n in ("block", "row", "part", "counters")), strict=True):
            at = from_gaps(data.as_py())
            out.append((block.as_py(), row.as_py(), part.as_py(), len(at), np.packbits(count[at] > 1).tobytes()))
        return table_of(ANSWER, out)

    return texts.groupBy("block").applyInArrow(partial, SKETCH).groupBy("row", "part").applyInArrow(merged, ANSWER)


def maybe_repeated(own: Block, answers: pa.Table, bits: int) -> np.ndarray:
    """Which windows have a counter of two or more in every row."""
    keep, told = np.ones(len(own.a), bool), sorted(answers.to_pylist(), key=lambda r: (r["row"], r["part"]))
    for row in range(DEPTH):
        reached = [np.unpackbits(np.frombuffer(r["reached"], np.uint8), count=r["n"]) for r in told if r["row"] == row]
        _, order = own.counters(row, bits)
        keep[order] &= np.concatenate([np.zeros(0, np.uint8), *reached]) > 0
    return keep


def planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte by byte, so that what they have in common costs little."""
    raw = np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(numbers).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def from_planes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = pa.Codec("zstd").decompress(data[4:], 8 * n, asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(8, n).T.copy().view("<i8").ravel()


def known_elsewhere(texts: DataFrame, answers: DataFrame, length: int, bits: int, shard_bits: int) -> DataFrame:
    """For each block, which of its windows (by their place among its distinct ones) stand elsewhere under a smaller doc_id."""

    def candidates(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return table_of(WINDOWS, [])
        own, block = Block(rows, length), rows.column("block")[0].as_py()
        at = np.flatnonzero(maybe_repeated(own, told, bits))
        shard = (own.a[at] >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(at), np.int64)
        return table_of(WINDOWS, [(block, s, gaps(at[p]), planes(own.least[at[p]]), own.a[at[p]].tobytes(), own.b[at[p]].tobytes()) for s, p in cut(shard)])

    def grouped(pieces: pa.Table) -> pa.Table:
        rows = pieces.to_pylist()
        a, b = (np.concatenate([np.frombuffer(r[n], np.uint64) for r in rows]) for n in ("a", "b"))
        docs = np.concatenate([from_planes(r["docs"]) for r in rows])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        least = np.empty(len(docs), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(docs[order], first), np.diff(np.append(first, len(a))))
        out, start = [], 0
        for r in rows:
            end = start + len(r["a"]) // 8
            hit = docs[start:end] > least[start:end]
            if hit.any():
                out.append((r["block"], gaps(from_gaps(r["at"])[hit])))
            start = end
        return table_of(ELSEWHERE, out)

    found = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(candidates, WINDOWS)
    return found.groupBy("shard").applyInArrow(grouped, ELSEWHERE)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with text, n_words and n_removed; text keeps its words outside repeated windows, joined by one space, if any
    was removed, and stays as it is otherwise.

    Windows are judged on the input. Of the documents that share a window the one with the smallest doc_id keeps it;
    repeats inside one document, or between rows of one doc_id, stay. A null text counts as empty and stays null; a null
    doc_id takes no part and keeps its text. All other columns stay, whatever their names; ones called n_words or n_removed
    are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("n_words", "n_removed")
    block = free_name(docs, "block")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    expected = max(1, size // 5)
    bits = max(10, int(LOAD * expected).bit_length())
    shard_bits = max(0, (expected // GROUP_WINDOWS).bit_length())
    rows = bucketed(with_block(docs, block), block, "blocks", size // BUCKET_BYTES)
    texts = rows.select(F.col(block).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = known_elsewhere(texts, sketch_answers(texts, length, bits), length, bits, shard_bits)

    def cleaned(own: pa.Table, told: pa.Table) -> pa.Table:
        at = own.schema.get_field_index("text")
        ids = own.column("doc_id").cast(pa.int64())
        made = Block(pa.table([ids, own.column(at)], ["doc_id", "text"]), length)
        elsewhere = np.zeros(len(made.a), bool)
        for data in told.column("at"):
            elsewhere[from_gaps(data.as_py())] = True
        gone, start, texts_, removed = made.covered(made.repeated(elsewhere)), 0, [], []
        for text, n in zip(own.column(at), made.sizes, strict=True):
            mine = gone[start : start + n]
            start += n
            removed.append(int(mine.sum()))
            texts_.append(b" ".join(w for w, g in zip(text.as_py().encode().split(), mine.tolist(), strict=True) if not g).decode() if removed[-1] else text.as_py())
        out = own.set_column(at, own.schema.field(at), pa.array(texts_, own.schema.field(at).type)).drop_columns([block])
        return out.append_column("n_words", pa.array(made.sizes, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    return rows.groupBy(block).cogroup(found.groupBy("block")).applyInArrow(cleaned, schema_with(docs, n_words="long", n_removed="long"))


def substring_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    kept = remove_repeats(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_removed"), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return kept.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
