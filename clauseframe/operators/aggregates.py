"""Aggregates over enumerations, facts and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import rank_of


def status_counts(column: str, values: tuple[str, ...], prefix: str = "n_") -> list[Column]:
    """One count for each value of an enumeration."""
    return [F.count_if(F.col(column) == v).alias(f"{prefix}{v.lower()}") for v in values]


def zero_filled_counts(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """A row for every value of the enumeration, also those that do not occur; other values are left out."""
    all_ = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return all_.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def most_severe(df: DataFrame, keys: list[str], severity: str, order: tuple[str, ...], *tie: str) -> DataFrame:
    """The row of each key with the highest severity, ties by ``tie``; as a partial aggregate, without a sort."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(rank_of(severity, order).alias("_rank"), *tie, *(c for c in rest if c not in tie)))
    return df.groupBy(*keys).agg(least.alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def earliest_fact(facts: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first fact of each key in document order; later ones never replace it."""
    rest = [c for c in facts.columns if c not in keys]
    row = F.struct(*order, *(c for c in rest if c not in order))
    return facts.groupBy(*keys).agg(F.min(row).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


BLOCK = 1024


def manifest_hash(df: DataFrame, keys: list[str], order: str, text: str, column: str = "manifest") -> DataFrame:
    """SHA-256 of the block hashes, joined by colons in order; a block's hash is that of its members' text hashes, joined likewise.

    A block holds the members whose ``order``, a whole number, has one quotient by ``BLOCK``. So no task holds a key's members
    together, however many there are: of each block 64 characters travel.
    """
    joined = lambda *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "_own"))), lambda x: x["_own"]), ":")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    own = df.select(*keys, order, F.floor(F.col(order) / BLOCK).alias("_block"), digest(F.coalesce(text, F.lit(""))).alias("_own"))
    blocks = own.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"), digest(joined(order)).alias("_own"))
    return blocks.groupBy(*keys).agg(F.sum("_n").alias("members"), digest(joined("_block")).alias(column))


def coverage_percent(status: Column) -> Column:
    """COVERED counts 1, PARTIAL a half; 100 for no rows. Rounded half up."""
    value = F.when(status == "COVERED", 1.0).when(status == "PARTIAL", 0.5).otherwise(0.0)
    return F.coalesce(F.floor(100 * F.avg(value) + 0.5), F.lit(100))
