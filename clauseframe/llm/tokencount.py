"""Token counts from flat token files by a separator scan.

A flat file holds identifiers of fixed width, one document after another, each closed by the end-of-document identifier;
there is no index. Files are read in blocks that know nothing of documents. Each block finds its separators in one
vectorised comparison and reports how many identifiers it has, how many separators, and where the last one is; a prefix
scan over those few numbers gives what each block's first document has in earlier blocks, and the documents' numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import portions, shared_dir
from .tokens import word_ids

VOCABULARY, END_ID = "word_bpe_49k.json", 49407
WIDTH = 2
BLOCK_BYTES = 4 << 20
FILE_BYTES = 64 << 20


def open_folder(uri: str):  # noqa: ANN201
    """(file system, path) of a local or remote folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_token_files(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, width: int = WIDTH) -> tuple[str, DataFrame]:
    """(folder, manifest): flat files of little-endian identifiers, and which doc_id is which document of which file.

    A task writes each file under a name of its own and only reports it when it is whole; what a lost or repeated attempt
    leaves is in no manifest. Documents keep the order in which the task reads them. A text that contains the separator's
    string keeps it as ordinary text, so that one separator closes one document. A null text counts as empty.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary, special=False)
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        end, task = np.array([end_id], f"<u{width}").tobytes(), TaskContext.get().partitionId()
        name, sink, size, held = "", None, 0, []

        def closed() -> pa.RecordBatch:
            sink.close()
            columns = (pa.array([name] * len(held), pa.string()), pa.array([size] * len(held), pa.int64()), pa.array(range(1, len(held) + 1), pa.int64()), pa.array(held, pa.int64()))
            return pa.RecordBatch.from_arrays(list(columns), ["file", "bytes", "doc", "doc_id"])

        for batch in batches:
            for doc, text in portions(batch, "doc_id", "text"):
                if sink is None:
                    name, size, held = f"{task:06d}-{uuid.uuid4().hex}.bin", 0, []
                    sink = system.open_output_stream(f"{path}/{name}")
                data = np.frombuffer(words.of(text or ""), "<u4").astype(f"<u{width}").tobytes() + end
                sink.write(data)
                size += len(data)
                held.append(doc)
                if size >= FILE_BYTES:
                    yield closed()
                    sink = None
        if sink is not None:
            yield closed()

    manifest = f"{folder}-manifest"
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, bytes long, doc long, doc_id long").write.parquet(manifest)
    return folder, spark.read.schema("file string, bytes long, doc long, doc_id long").parquet(manifest)


def count_tokens(spark: SparkSession, folder: str, files: DataFrame, end_id: int = END_ID, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of the flat ``files`` (file, bytes) in ``folder``: file, doc (from 1), start, n_tokens.

    ``start`` counts identifiers from the file's beginning; ``n_tokens`` leaves the separator out. Identifiers after the
    last separator make one more document, unless there are none. Bytes that do not fill an identifier are not read. Two
    separators in a row close an empty document. Files may be of any size: a task holds one block. An empty table gives an
    empty table.
    """
    ids = block_bytes // width
    blocks = files.select("file", (F.col("bytes") / width).cast("long").alias("n")).where("n > 0")
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ids))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            rows = []
            for name, n, block in zip(*(batch.column(c).to_pylist() for c in ("file", "n", "block")), strict=True):
                first, size = block * ids, min(ids, n - block * ids)
                with system.open_input_file(f"{path}/{name}") as source:
                    source.seek(first * width)
                    found = np.flatnonzero(np.frombuffer(source.read(size * width), f"<u{width}") == end_id) + first
                rows.append((name, n, block, found))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["file", "n", "block", "ends"])

    # rows are dealt one by one, so that each task reads a few blocks
    dealt = blocks.repartition(max(1, min(10_000, blocks.count())), "file", "block")
    scanned = dealt.mapInArrow(scan, "file string, n long, block long, ends array<long>")
    path = f"{folder}-blocks-{uuid.uuid4().hex}"
    scanned.write.parquet(path)  # read twice below
    scanned = spark.read.schema("file string, n long, block long, ends array<long>").parquet(path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned.select("file", "block", F.size("ends").alias("found"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last")).select(
        "file", "block", F.coalesce(F.sum("found").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("open_from")
    )
    at = scanned.join(carried, ["file", "block"])
    closed = at.select("file", "docs_before", "open_from", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("docs_before") + F.col("i") + 1).alias("doc"), F.when(F.col("i") == 0, F.col("open_from")).otherwise(F.element_at("ends", F.when(F.col("i") == 0, 1).otherwise(F.col("i"))) + 1).alias("start"), "end"
    )
    tail = scanned.groupBy("file").agg(F.max("n").alias("end"), F.sum(F.size("ends")).alias("docs"), F.coalesce(F.max(F.array_max("ends")) + 1, F.lit(0)).alias("start")).where("start < end")
    rows = closed.unionByName(tail.select("file", (F.col("docs") + 1).alias("doc"), "start", "end"))
    return rows.select("file", "doc", "start", (F.col("end") - F.col("start")).alias("n_tokens"))


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens of every document: its flat token files are written, then scanned without an index."""
    folder, manifest = write_token_files(docs)
    files = manifest.groupBy("file").agg(F.max("bytes").alias("bytes"))
    return count_tokens(docs.sparkSession, folder, files).join(manifest.select("file", "doc", "doc_id"), ["file", "doc"]).select("doc_id", "n_tokens")
