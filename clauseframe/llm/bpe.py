"""Byte-level BPE over a table of distinct words, and decoding by a join of ids to pieces.

Encoding has four steps, and no step holds more than a block of documents or a shard of words:

1. Each task cuts its texts into words, block by block (at most ``BLOCK`` characters and one document more), and writes
   the block's distinct words and each document as positions in that list. The written table is read by all later steps.
2. The distinct words of all blocks are dealt to shards by a hash, so that all copies of a word meet.
3. A shard encodes each distinct word once and answers every block's list with the ids.
4. Each block's answers meet its documents' positions where they lie, and the ids are joined back by position.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, portions
from .tokens import load, units

VOCABULARY = "byte_bpe_50k.json"
BLOCK, CHUNK, SHARD = 24_000_000, 500_000, 8_000_000
#: In place of a shard: a block's documents, and the places of its words.
DOCS, PLACES = -1, -2
PARTS = "block long, shard int, words binary, doc_ids array<long>, counts array<int>, codes binary"
PARTS_ARROW = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("words", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("codes", pa.binary())])


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed: all lowest bytes first, then all next ones, so that small numbers cost little."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(4, "little") + pa.Codec("zstd", 3).compress(planes, asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = pa.Codec("zstd").decompress(data[4:], 4 * n, asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def packed_words(words: list[str]) -> bytes:
    """Words, compressed; each is told from the next by its length, as it may hold any character."""
    data = [w.encode() for w in words]
    sizes, text = packed(np.array([len(w) for w in data], "<u4")), b"".join(data)
    return len(sizes).to_bytes(4, "little") + sizes + len(text).to_bytes(4, "little") + pa.Codec("zstd", 3).compress(text, asbytes=True)


def unpacked_words(data: bytes) -> list[str]:
    at = 4 + int.from_bytes(data[:4], "little")
    text = pa.Codec("zstd").decompress(data[at + 4 :], int.from_bytes(data[at : at + 4], "little"), asbytes=True)
    ends = np.cumsum(unpacked(data[4:at]), dtype=np.int64).tolist()
    return [text[s:e].decode() for s, e in zip([0, *ends], ends, strict=False)]


class Codes(dict):
    """Word -> its position in the order of first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def block_rows(block: int, docs: list[tuple[int, np.ndarray]], codes: Codes, shards: int) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its words shard by shard, sorted, then its documents in chunks.

    A document is a list of ranks, frequent words first; a row of its own says where each rank's word stands in the shards.
    """
    words = list(codes)
    counts = np.bincount(np.concatenate([own for _, own in docs]), minlength=len(words))
    by_rank = np.argsort(-counts, kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[by_rank] = np.arange(len(words), dtype=np.uint32)
    at = np.fromiter((zlib.crc32(w.encode()) % shards for w in words), np.int64, len(words))
    order = np.array(sorted(range(len(words)), key=lambda i: (at[i], words[i])), np.int64)
    place = np.empty(len(words), np.uint32)
    place[order] = np.arange(len(words), dtype=np.uint32)
    row = lambda **x: pa.RecordBatch.from_arrays([pa.array([x.get(f.name)], f.type) for f in PARTS_ARROW], schema=PARTS_ARROW)
    for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        if len(part):
            yield row(block=block, shard=int(at[part[0]]), words=packed_words([words[i] for i in part]))
    yield row(block=block, shard=PLACES, words=packed(place[by_rank]))
    start = size = 0
    for i, (_, own) in enumerate(docs):
        size += len(own)
        if size >= CHUNK or i + 1 == len(docs):
            chunk = docs[start : i + 1]
            yield row(block=block, shard=DOCS, doc_ids=[d for d, _ in chunk], counts=[len(c) for _, c in chunk], codes=packed(rank[np.concatenate([c for _, c in chunk])]))
            start, size = i + 1, 0


def split_words(docs: DataFrame, shards: int) -> DataFrame:
    """Step 1, as a table in the shared folder, bucketed by block: the documents' positions are not shuffled again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, codes, held, chars = TaskContext.get().partitionId() << 32, Codes(), [], 0
        for batch in batches:
            for doc, text in portions(batch, "doc_id", "text"):
                own = units(text or "")
                held.append((doc, np.fromiter(map(codes.__getitem__, own), np.uint32, len(own))))
                chars += len(text or "")
                if chars >= BLOCK:
                    yield from block_rows(block, held, codes, shards)
                    block, codes, held, chars = block + 1, Codes(), [], 0
        if held:
            yield from block_rows(block, held, codes, shards)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PARTS)
    return bucketed(made, "block", "words")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ids (array of int), as the tokenizer gives them for the whole text.

    A null or empty text has no ids. Rows are never matched by doc_id, so repeated rows and null ids come out as they are.
    Other columns are not read. An empty table gives an empty table.
    """
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = split_words(docs, max(1, chars // SHARD))
    words, chunks = parts.where("shard >= 0").select("block", "shard", "words"), parts.where(F.col("shard") == DOCS).select("block", "doc_ids", "counts", "codes")
    places = parts.where(F.col("shard") == PLACES).select("block", "shard", F.lit(None).cast("binary").alias("sizes"), F.col("words").alias("ids"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, known = load(vocabulary), {}
        for batch in batches:
            out = []
            for data in batch.column("words").to_pylist():
                own = unpacked_words(data)
                new = [w for w in own if w not in known]
                for w, e in zip(new, tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, "<u4").tobytes()
                ids = [known[w] for w in own]
                out.append((packed(np.array([len(x) // 4 for x in ids], "<u4")), packed(np.frombuffer(b"".join(ids), "<u4"))))
            columns = [batch.column("block"), batch.column("shard"), *(pa.array([o[i] for o in out], pa.binary()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "shard", "sizes", "ids"])

    answers = words.groupBy("shard").applyInArrow(encoded, "block long, shard int, sizes binary, ids binary")

    def joined(docs_: pa.Table, told: pa.Table) -> pa.Table:
        """One block: its answers are unpacked once, its documents chunk by chunk."""
        first, *own = sorted(told.to_pylist(), key=lambda a: a["shard"])
        none, order = np.zeros(0, "<u4"), unpacked(first["ids"])
        sizes = np.concatenate([none, *(unpacked(a["sizes"]) for a in own)]).astype(np.int64)
        ids = np.concatenate([none, *(unpacked(a["ids"]) for a in own)]).astype(np.int32)
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes, out = sizes[order], []
        for i in range(docs_.num_rows):
            doc_ids, counts, codes = (docs_.column(n)[i].as_py() for n in ("doc_ids", "counts", "codes"))
            code = unpacked(codes)
            n = sizes[code]
            upto = np.cumsum(n)
            values = ids[np.arange(n.sum()) + np.repeat(starts[code] - (upto - n), n)]
            ends = np.append(0, upto)[np.append(0, np.cumsum(counts))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            out.append(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], ["doc_id", "ids"]))
        return pa.Table.from_batches(out)

    # the documents' side is bucketed by block, so only the answers are shuffled
    return chunks.groupBy("block").cogroup(answers.unionByName(places).groupBy("block")).applyInArrow(joined, "doc_id long, ids array<int>")


def pieces(vocabulary: str = VOCABULARY) -> list[bytes]:
    """The bytes of each id, in order. Byte-level vocabularies spell a byte as a printable character."""
    tokenizer = load(vocabulary)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out = [b""] * tokenizer.get_vocab_size()
    for piece, i in tokenizer.get_vocab().items():
        out[i] = bytes(spelled[c] for c in piece) if all(c in spelled for c in piece) else piece.encode()
    return out


def decode(rows: DataFrame, ids: str = "ids", column: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` with the text of the array column ``ids`` in ``column``, in place of ``ids``.

    A map-side join: the id-to-piece table is the vocabulary's, so its size is fixed, and each task looks the ids of a
    batch up in its broadcast copy. Bytes that are no UTF-8 become U+FFFD. A null array counts as empty.
    """
    shared = rows.sparkSession.sparkContext.broadcast(pieces(vocabulary))
    kept = rows.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(shared.value, object)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                at = batch.schema.get_field_index(ids)
                lists = batch.column(at)
                ends = lists.offsets.to_numpy()
                flat = table[lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]]
                ends = ends - ends[0]
                texts = [b"".join(flat[s:e].tolist()).decode("utf-8", "replace") for s, e in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(texts, pa.large_string())], [*(n for n in batch.schema.names if n != ids), column])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != ids), f"`{column}` string"])
    return kept.withColumn(ids, F.coalesce(F.col(ids), F.array().cast("array<int>"))).mapInArrow(run, schema)


def bpe_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: digests of the ids and of the text decoded from them."""
    ids = encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"), "ids")
    return decode(ids).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
