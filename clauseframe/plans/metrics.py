"""Quality gates: recall and precision, and referential integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_precision(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """n, recall, precision over all rows; 0 where a denominator is 0."""
    both = F.sum((gold & predicted).cast("int"))
    ratio = lambda of: F.round(F.coalesce(F.try_divide(both, F.sum(of.cast("int"))), F.lit(0.0)), 6)
    return df.agg(F.count(F.lit(1)).alias("n"), ratio(gold).alias("recall"), ratio(predicted).alias("precision"))


def dangling(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(check, failures): for each (name, child, foreign key, parent, key), the child rows whose key the parent lacks."""

    def one(name: str, child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
        known = parent.select(F.col(key).alias("_key")).distinct()
        lost = child.where(F.col(fk).isNotNull()).select(F.col(fk).alias("_fk")).join(known, F.col("_fk") == F.col("_key"), "left_anti")
        return lost.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("failures"))

    return reduce(DataFrame.unionByName, (one(*c) for c in checks))


#: What a release needs at least. Fixed values.
LEAST = {"violation_recall": 0.9, "warning_precision": 0.95, "protection_recall": 0.85}


def release_gate(gold: DataFrame, predicted: DataFrame, missing: DataFrame, reported: DataFrame) -> DataFrame:
    """One row: violation_recall, warning_precision, protection_recall and passed.

    ``gold`` and ``predicted`` are (case_id, clause_id, severity, violates), ``missing`` the protections that an agreement lacks
    (case_id, item), ``reported`` what was said of them (case_id, item, status). A violation is found if the clause is RED and
    said to violate; a warning is right if the severity is the annotated one; a missing protection is found unless it is said
    to be covered. Without violations or warnings the share is 0, without missing protections 1.
    """
    keys = ["case_id", "clause_id"]
    told = predicted.select(*keys, F.col("severity").alias("said"), F.col("violates").alias("said_violates"))
    rows = gold.join(told, keys, "full_outer")
    warned = F.coalesce(F.col("said").isin("RED", "ORANGE"), F.lit(False))
    found = F.col("violates") & (F.col("said") == "RED") & F.col("said_violates")
    share = lambda part, of, none: F.round(F.coalesce(F.try_divide(F.count_if(part), F.count_if(of)), F.lit(none)), 6)
    clauses = rows.agg(share(found, F.col("violates"), 0.0).alias("violation_recall"), share(warned & (F.col("severity") == F.col("said")), warned, 0.0).alias("warning_precision"))
    lacking = missing.join(reported.where("status <> 'COVERED'").select("case_id", "item", F.lit(True).alias("seen")).distinct(), ["case_id", "item"], "left")
    protections = lacking.agg(share(F.col("seen"), F.lit(True), 1.0).alias("protection_recall"))
    both = clauses.unionByName(protections, allowMissingColumns=True).agg(*(F.max(n).alias(n) for n in LEAST))
    return both.withColumn("passed", reduce(lambda a, b: a & b, (F.col(n) >= v for n, v in LEAST.items())))
