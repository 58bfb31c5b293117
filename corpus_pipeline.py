"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of ``documents``, and extra ones that they have; ``n_chars`` follows a text that a stage changes.

All stages take a null text for an empty one and an empty table for an empty result. Rows that are equal, or repeat a doc_id,
go through one by one. A row without a doc_id takes no part in a comparison with others: neither near-duplicate nor repeated
passage, it stays and is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.llm.common import table, written
from clauseframe.llm.neardup import keep_one
from clauseframe.llm.packing import expected_pieces, pack, token_pieces
from clauseframe.llm.quality import keep_good
from clauseframe.llm.secrets import redact_secrets
from clauseframe.llm.substrings import remove_repeats


#: Fewer than the operator's own default, as the workers still hold what earlier stages left.
HELD_WORDS = 200_000


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject. Labels or texts that are null are no
    obstacle; without labels all scores are equal and everything stays."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; rows that share that doc_id all stay."""
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a smaller doc_id has too; one that loses all its words stays, empty."""
    return counted(remove_repeats(docs).drop("n_words", "n_removed"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    return counted(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece of every document."""
    return pack(token_pieces(docs, held_words=HELD_WORDS), expected_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("secrets", secrets),
    ("packing", packing),
]

#: No SQL: the classifier, the tokenizer and the packing have none. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
