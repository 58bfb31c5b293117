"""Join shapes: lookups with a fallback, status differences, pairing of occurrences, interval and as-of selection.

Which side is broadcast is left to Catalyst, which knows the sizes; nothing here forces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_with_fallback(facts: DataFrame, exact: DataFrame, general: DataFrame, key: str, parent: str, value: str) -> DataFrame:
    """``value`` by ``key``, or else by ``parent``; rows that neither resolves are dropped. The dimensions have unique keys."""
    a = exact.select(key, F.col(value).alias("_exact"))
    b = general.select(parent, F.col(value).alias("_general"))
    joined = facts.join(a.hint("merge"), key, "left").join(b.hint("merge"), parent, "left").withColumn(value, F.coalesce("_exact", "_general"))
    return joined.where(F.col(value).isNotNull()).drop("_exact", "_general")


def full_outer_status(before: DataFrame, after: DataFrame, key: str, status: str) -> DataFrame:
    """Both sides' status of every key, null where a side lacks it, and what became of it."""
    b, a = before.select(key, F.col(status).alias("before")), after.select(key, F.col(status).alias("after"))
    change = F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "REMOVED").when(F.col("before") == F.col("after"), "UNCHANGED").otherwise("CHANGED")
    return b.join(a.hint("merge"), key, "full_outer").withColumn("change", change)


def occurrence_pairs(left: DataFrame, right: DataFrame, text: str, left_order: Column, right_order: Column) -> DataFrame:
    """The k-th occurrence of a text on the left with its k-th on the right."""
    numbered = lambda df, order: df.withColumn("occurrence", F.row_number().over(Window.partitionBy(text).orderBy(order)))
    return numbered(left, left_order).join(numbered(right, right_order).hint("merge"), [text, "occurrence"])


def shared_member_pairs(members: DataFrame, key: str, item: str) -> DataFrame:
    """Distinct ordered pairs of items that share a key, found by an equi-join on the key."""
    a, b = members.select(key, F.col(item).alias("item_a")), members.select(key, F.col(item).alias("item_b"))
    return a.join(b.hint("merge"), key).where("item_a < item_b").select("item_a", "item_b").distinct()


def as_of(facts: DataFrame, history: DataFrame, key: str, at: str, valid_from: str, *values: str) -> DataFrame:
    """The newest history row of the key that is not later than the fact, by one union and one window instead of a range
    join: the cost is a sort, whatever the number of versions."""
    kinds = {c: t for c, t in [*facts.dtypes, *history.dtypes]}
    f = facts.select("*", F.col(at).alias("_at"), F.lit(1).alias("_fact"), *(F.lit(None).cast(kinds[v]).alias(v) for v in values))
    h = history.select(key, F.col(valid_from).alias("_at"), F.lit(0).alias("_fact"), *values)
    window = Window.partitionBy(key).orderBy("_at", "_fact").rowsBetween(Window.unboundedPreceding, 0)
    both = f.unionByName(h, allowMissingColumns=True)
    filled = both.select(*(F.last(v, ignorenulls=True).over(window).alias(v) if v in values else F.col(v) for v in both.columns))
    return filled.where("_fact = 1").drop("_fact", "_at")
