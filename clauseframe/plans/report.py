"""The report of an agreement: findings in order, their summary, shared topics, issues across clauses, and what to raise first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.aggregates import most_severe
from ..operators.ranking import SEVERITIES, rank_of

CONFIDENCES = ("high", "medium", "low")
ISSUES = ("RED", "ORANGE", "SUGGESTION", "TENANT")


def findings(clauses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each verdict with ``rank`` in its agreement (severity, confidence, document order), ``quote``, ``peers`` (other clauses with a
    finding on the topic) and ``key``, which marks the first five that are not OK."""
    rows = verdicts.join(clauses.select("contract_id", "clause_id", "ord", "text").hint("merge"), ["contract_id", "clause_id"])
    order = (rank_of("severity", SEVERITIES), rank_of("confidence", CONFIDENCES), F.col("ord"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("contract_id").orderBy(*order))).withColumn("quote", T.capped("text", 280))
    counts = (F.col("severity") != "OK") & (F.col("topic") != "other")
    of_topic = Window.partitionBy("contract_id", "topic").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_ = F.collect_list(F.when(counts, F.col("clause_id"))).over(of_topic)
    peers = F.when(counts, F.array_remove(all_, F.col("clause_id"))).otherwise(F.array().cast("array<string>"))
    return ranked.withColumn("peers", peers).withColumn("key", (F.col("severity") != "OK") & (F.col("rank") <= 5)).drop("text")


def summary(found: DataFrame) -> DataFrame:
    """(contract_id, red, orange, ok)."""
    return found.groupBy("contract_id").agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES))


def across_clauses(issues: DataFrame) -> DataFrame:
    """Issues (contract_id, kind, clause_ids, severity, ord, explanation) that name one set of clauses become one, the most severe."""
    keyed = issues.withColumn("clause_ids", F.array_sort(F.array_distinct("clause_ids")))
    return most_severe(keyed, ["contract_id", "kind", "clause_ids"], "severity", SEVERITIES, "ord")


def negotiation_issues(found: DataFrame, protections: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """(contract_id, issue_id, kind, severity, rank, priority): findings and missing protections, worst first. What was flagged
    (contract_id, issue_id) has priority, or everything where an agreement has nothing flagged."""
    a = found.where("severity <> 'OK'").select("contract_id", F.concat(F.lit("F-"), "clause_id").alias("issue_id"), F.lit("FINDING").alias("kind"), "severity", F.col("rank").alias("at"))
    b = protections.where("status <> 'COVERED'").select("contract_id", F.concat(F.lit("P-"), "item").alias("issue_id"), F.lit("PROTECTION").alias("kind"), F.lit("SUGGESTION").alias("severity"), F.lit(0).alias("at"))
    of = Window.partitionBy("contract_id")
    rows = a.unionByName(b).withColumn("rank", F.row_number().over(of.orderBy(rank_of("severity", ISSUES), "at", "issue_id"))).drop("at")
    if flagged is None:
        return rows.withColumn("priority", F.lit(True))
    marked = rows.join(flagged.select("contract_id", "issue_id", F.lit(True).alias("f")).hint("merge"), ["contract_id", "issue_id"], "left")
    some = F.coalesce(F.bool_or("f").over(of), F.lit(False))
    return marked.withColumn("priority", F.coalesce("f", ~some)).drop("f")
