"""Order MinHash fingerprints: signatures that follow the edit distance.

A text's k-mers are numbered by occurrence, so a repeated k-mer counts as often as it stands. Under each of ``SIZE``
permutations the ``TUPLE`` smallest are selected, put back into text order and hashed together. Two texts agree in a
component if the same k-mers are selected and stand in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, partitions, schema_with, windows, written

K, SIZE, TUPLE = 8, 32, 2
_SEEDS = mixed(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
XOR = (_SEEDS[:SIZE] >> np.uint64(32)).astype(np.uint32)
MULTIPLY = (_SEEDS[SIZE:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def order_minhash(text: str) -> np.ndarray:
    """``SIZE`` unsigned 32-bit components. An empty text has zeros; one of fewer than ``K`` characters has one k-mer, itself."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.zeros(SIZE, np.uint32)
    h = windows(points + np.uint64(1), min(K, len(points)))
    n = len(h)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]]))
    seen = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = seen
    h = mixed(h + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))
    low = h.astype(np.uint32)
    chosen = np.empty((TUPLE, SIZE), np.int64)
    step = max(1, 65536 // n)
    for at in range(0, SIZE, step):
        own = slice(at, min(SIZE, at + step))
        v = (low[None, :] ^ XOR[own, None]) * MULTIPLY[own, None]
        rows = np.arange(v.shape[0])
        for i in range(TUPLE):
            chosen[i, own] = v.argmin(axis=1)
            v[rows, chosen[i, own]] = np.uint32(0xFFFFFFFF)
    chosen.sort(axis=0)
    out = np.zeros(SIZE, np.uint64)
    for i in range(TUPLE):
        out = mixed(out * np.uint64(3) + h[chosen[i]])
    return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal components, 0 to 1."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of the whole text, in hex. Narrow. A null text counts as empty; all rows and columns
    stay, and a column of that name is replaced."""
    kept = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shown(order_minhash(t or "")) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], [*b.schema.names, column])

    return kept.mapInArrow(run, schema_with(kept, **{column: "string"}))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
RESULT_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compared(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    """One result row: the text against its edited form, and against the next text."""
    third = len(text) // 3
    edited = text[: len(text) - third] + following[:third]
    changed = order_minhash(edited)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return doc_id, len(text), digest, shown(own), shown(changed), likeness(own, changed), likeness(own, other)


def neighbour_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; the next document is the one before it by doc_id, and the first follows the last.

    One range shuffle by doc_id; a task streams its sorted texts and fingerprints each once. What a task cannot finish, its
    last document, meets the first of the next task afterwards: two rows a task. Null ids come last in the order, ties
    follow the text, and a single document follows itself. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    order = (F.col("doc_id").desc_nulls_last(), F.col("text"))
    tasks = max(partitions(spark), int(chars // 16_000_000) + 1)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(tasks, order[0]).sortWithinPartitions(*order)
    done, head, tail = 0, 1, 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def batch_of(kind: int, rows: list[tuple], texts: list[str | None]) -> pa.RecordBatch:
            n = len(rows)
            columns = [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(RESULT_KINDS))], ["kind", "part", "text", *RESULT_NAMES])

        blank = (None,) * 7
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = last[2] if last and last[1] == text else order_minhash(text)
                if last:
                    rows.append(compared(*last, text, own))
                else:
                    yield batch_of(head, [blank], [text])
                last = (doc_id, text, own)
            if rows:
                yield batch_of(done, rows, [None] * len(rows))
        if last:
            yield batch_of(tail, [(last[0], *blank[1:])], [last[1]])

    passed = written(ordered.mapInArrow(run, f"kind int, part int, text string, {RESULT}"), "fingerprints")
    tails, heads = passed.where(F.col("kind") == tail), passed.where(F.col("kind") == head).select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    follows = tails.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    pairs = tails.select("part", "doc_id", "text").join(follows, "part").join(heads, "next_part").select("doc_id", "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [compared(d, t, order_minhash(t), n, order_minhash(n)) for d, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(RESULT_KINDS)], RESULT_NAMES)

    return passed.where(F.col("kind") == done).select(*RESULT_NAMES).unionByName(pairs.mapInArrow(finish, RESULT))
