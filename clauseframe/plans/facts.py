"""Concepts, facts and the subject a number belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound


def concept_counts(df: DataFrame, concepts: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, concept, n) of the concepts that occur. Each pattern is a literal; one row gives one small array."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*(F.struct(F.lit(c).alias("concept"), F.regexp_count(low, F.lit(p)).alias("n")) for c, p in concepts.items()))
    return df.select(key, F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x")).select(key, "x.concept", "x.n")


def primary_concepts(counts: DataFrame, in_heading: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, concept, n): what a part is mainly about: named in its heading, met twice, or met most often, if it alone is or
    the heading names none."""
    heading = in_heading.select(key, "concept", F.lit(True).alias("named")) if in_heading is not None else None
    rows = counts.join(heading.hint("merge"), [key, "concept"], "left") if heading is not None else counts.withColumn("named", F.lit(False))
    rows = rows.withColumn("named", F.coalesce("named", F.lit(False)))
    part = Window.partitionBy(key)
    most = F.max("n").over(part)
    alone = F.sum((F.col("n") == F.col("most")).cast("int")).over(part) == 1
    rows = rows.withColumn("most", most).withColumn("alone", alone).withColumn("headed", F.max("named").over(part))
    return rows.where(F.col("named") | (F.col("n") >= 2) | ((F.col("n") == F.col("most")) & (F.col("alone") | ~F.col("headed")))).select(key, "concept", "n")


def occurrences(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<at, hit>> of a pattern's matches, ``at`` from 1. Positions follow from the lengths of what lies between."""
    between = lambda: F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,hit:string>>").alias("out"))
    step = lambda acc, x: F.struct(
        (acc["end"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), F.concat(acc["out"], F.array(F.struct((acc["end"] + F.length(x["gap"]) + 1).alias("at"), x["hit"].alias("hit")))).alias("out")
    )

    def placed(hits: Column) -> Column:
        zipped = bound(between(), lambda gaps: F.arrays_zip(F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap"), hits.alias("hit")))
        # most texts hold none, so they are not split
        return F.when(F.size(hits) > 0, F.aggregate(zipped, start, step)["out"]).otherwise(F.array().cast("array<struct<at:int,hit:string>>"))

    return bound(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), placed)


def nearest_subject(numbers: DataFrame, subjects: DataFrame, keys: list[str]) -> DataFrame:
    """Each number (keys, at, hit) with the subject (keys, at, hit, subject) closest before it, ties to the longer; failing
    that, the closest one after it. Numbers without a subject in their sentence are left out."""
    n = numbers.select(*keys, F.col("at").alias("number_at"), F.col("hit").alias("number"))
    s = subjects.select(*keys, F.col("at").alias("subject_at"), F.length("hit").alias("size"), "subject")
    order = F.struct((F.col("subject_at") > F.col("number_at")).alias("after"), F.abs(F.col("number_at") - F.col("subject_at")).alias("distance"), (-F.col("size")).alias("shorter"), "subject")
    return n.join(s.hint("merge"), keys).where("subject_at <> number_at").groupBy(*keys, "number_at", "number").agg(F.min(order)["subject"].alias("subject"))
