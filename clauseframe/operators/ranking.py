"""Ordered scans: first or last of a key, occurrence numbers, neighbours, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("RED", "ORANGE", "OK")


def rank_of(value: Column | str, order: tuple[str, ...]) -> Column:
    """The position of a value in an enumeration, from 0; unknown values come last."""
    position = F.array_position(F.array(*map(F.lit, order)), F.col(value) if isinstance(value, str) else value)
    return F.when(position > 0, position - 1).otherwise(len(order)).cast("int")


def first_per_key(df: DataFrame, keys: list[str], *order: Column, n: int = 1, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1 in ``rank``. The order must be total for a stable result."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def with_instance(df: DataFrame, key: str, *order: Column, column: str = "instance_id") -> DataFrame:
    """The key, with ``-INSTANCE-n`` where it occurs more than once."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    of = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn(column, F.when(of > 1, F.concat(key, F.lit("-INSTANCE-"), n.cast("string"))).otherwise(F.col(key)))


def next_survivor(df: DataFrame, keys: list[str], position: str, value: str, column: str) -> DataFrame:
    """The next value that is not null after a row, less a half: where a removed row is shown."""
    after = Window.partitionBy(*keys).orderBy(position).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(column, F.first(value, ignorenulls=True).over(after) - 0.5)


def relative_position(df: DataFrame, keys: list[str], *order: Column, column: str = "relative") -> DataFrame:
    """(place - 1) / (count - 1) within the keys; 0 for a single row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(column, F.when(n > 1, at / (n - 1)).otherwise(0.0))


def within_budget(df: DataFrame, keys: list[str], text: str, budget: int, *order: Column) -> DataFrame:
    """Rows of each key in order while a budget of characters lasts; the last one's text is cut to what remains."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = df.withColumn("used", F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)))
    kept = used.where(F.col("used") < budget)
    return kept.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("used")).cast("int")))


def running_groups(df: DataFrame, keys: list[str], starts: Column, *order: Column, column: str = "group") -> DataFrame:
    """A running number of the rows for which ``starts`` holds; the first row starts one in any case."""
    window = Window.partitionBy(*keys).orderBy(*order)
    begin = F.when((F.row_number().over(window) == 1) | starts, 1).otherwise(0)
    return df.withColumn("_begin", begin).withColumn(column, F.sum("_begin").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_begin")
