"""Lineage of versions: from each row's parent to the root of its chain and its number in it."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled


def lineage(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, version) of each distinct key: the first of the chain of parents, and how many stand before, from 1.

    Pointer doubling: each round every open row takes over where its pointer points to, so a chain of n takes about log2(n) rounds,
    each one join and written once. A parent that is null, or is no row, makes a root; of several parents the smallest counts. Rows on
    a loop, or that lead to one, have neither root nor version. Null keys take no part.
    """
    own = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(parent).alias("up"))
    ids = own.select(F.col(key).alias("up"), F.lit(True).alias("known"))
    first = own.join(ids, "up", "left").select(F.col(key).alias("id"), F.when(F.col("known"), F.col("up")).alias("up"))
    # a root points at itself
    now = settled(first.select("id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("up").isNull().alias("done")))
    for _ in range(ceil(log2(max(2, now.count()))) + 1):
        open_ = now.where(~F.col("done"))
        if open_.isEmpty():
            break
        far = now.select(F.col("id").alias("via"), F.col("up").alias("to"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        moved = open_.join(far, open_.up == far.via).select("id", F.col("to").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"))
        now = settled(now.where("done").unionByName(moved))
    return now.select(F.col("id").alias(key), F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("steps") + 1).alias("version"))
