"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def least(rows: DataFrame) -> DataFrame:
    """(a, m): the smallest of a and its neighbours b."""
    return rows.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))


def large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked with its smallest one.

    The smallest ones are written first: so both sides of the join are plain tables, which Spark joins by broadcast where
    one is small, and else by a sort whose partitions it splits where a node has very many neighbours.
    """
    rows = both_ways(links)
    return rows.where("b > a").join(written(least(rows), "least"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    rows = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = written(least(rows), "least")
    moved = rows.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b), both of one type; component is the smallest node reachable.

    Only counts and one checksum a round go to the driver. Each round's links are written to the shared folder, so that
    plans stay short and lost executors cost a round's part at most. Loops, repeated links and either direction are fine;
    rows with a null take no part. The number of rounds grows with the logarithm of the longest path.
    """
    now = written(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = state
        now = written(small_star(large_star(now)), "links")
