"""Documents to lines, clauses, sentences and bounded chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ranking import running_groups
from ..operators.streams import small

TARGET, MOST = 250, 300
#: Lines that say nothing: page marks, bare numbers or dates, rulers. Fixed values.
JUNK = (
    r"^\s*(?:page|עמוד|seite|página)\s+\d+(?:\s*(?:of|/|מתוך|von|de)\s*\d+)?\s*$",
    r"^[\s\d./:,\-]{1,80}$",
    r"^[\s_=*~.\-]{1,80}$",
)


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, line) of every line that is not blank."""
    return docs.select(key, F.explode(T.lines(text)).alias("x")).select(key, "x.ord", "x.line")


def explode_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(T.sentences(text)).alias("ord", "sentence"))


def is_junk(line: Column | str) -> Column:
    c = F.lower(T.col(line))
    out = F.length(F.trim(c)) == 0
    for pattern in JUNK:
        out = out | F.rlike(c, F.lit(pattern))
    return out


def clause_groups(lines: DataFrame, starts: Column, key: str = "doc_id") -> DataFrame:
    """(key, clause, ord, line): lines in groups that begin where ``starts`` holds."""
    return running_groups(lines, [key], starts, F.col("ord"), column="clause")


def repeated_lines(lines: DataFrame, key: str = "doc_id", least: int = 2) -> DataFrame:
    """(norm): the normalised lines of at least ``least`` documents. Lines are counted by digest, once a document."""
    once = lines.select(key, F.md5(T.normalized("line")).alias("norm")).distinct()
    return once.groupBy("norm").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("norm")


def without_furniture(lines: DataFrame, key: str = "doc_id", least: int = 2) -> DataFrame:
    """The lines that do not recur in ``least`` documents."""
    return lines.withColumn("norm", F.md5(T.normalized("line"))).join(repeated_lines(lines, key, least), "norm", "left_anti").drop("norm")


def packed(lines: list[str], target: int = TARGET, most: int = MOST) -> list[str]:
    """One clause's chunks: whole if it has at most ``most`` words. Else longer lines are cut into ``target`` words, and a chunk
    closes when the next line would exceed ``most`` and it holds at least four fifths of ``target``."""
    if sum(len(x.split()) for x in lines) <= most:
        return ["\n".join(lines)]
    pieces: list[tuple[str, int]] = []
    for x in lines:
        w = x.split()
        pieces += [(x, len(w))] if len(w) <= most else [(" ".join(w[i : i + target]), len(w[i : i + target])) for i in range(0, len(w), target)]
    chunks, own, n = [], [], 0
    for x, size in pieces:
        if own and n + size > most and n >= target * 0.8:
            chunks.append("\n".join(own))
            own, n = [], 0
        own.append(x)
        n += size
    return [*chunks, "\n".join(own)] if own else chunks


def pack_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, chunk): the greedy packing of each document's lines. The packing is a sequential rule, so it runs over
    Arrow batches; a document is one row before and after, and nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            chunks = [packed([x for x in (t or "").replace("\r\n", "\n").split("\n") if x.strip()]) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chunks, pa.list_(pa.string()))], [key, "chunks"])

    made = docs.select(key, text).mapInArrow(run, f"{key} {kind}, chunks array<string>")
    return made.select(key, F.posexplode("chunks").alias("part", "chunk")).where("chunk <> ''").withColumn("part", F.col("part") + 1)
