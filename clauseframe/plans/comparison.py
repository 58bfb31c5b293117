"""Two versions of agreements compared as one plan: both are analysed, their clauses aligned, and what changed is read off: the status of each
clause, of each protection, and what the agreement costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import full_outer_status
from ..session import settled
from . import align, analyses, schedule, terms

STATUSES = ("FIXED", "IMPROVED", "STILL_OPEN", "WORSENED", "NEW_ISSUE", "UNREQUESTED_CHANGE", "UNCHANGED")


@dataclass(frozen=True)
class Comparison:
    """By pair_id: ``clauses`` (an alignment row each, with severities and status), ``protections`` (item, before, after, change) and ``costs``
    (cost_before, cost_after; null where an agreement does not tell its rent and term)."""

    clauses: DataFrame
    protections: DataFrame
    costs: DataFrame

    def counts(self) -> DataFrame:
        """(pair_id, a column for each status)."""
        return self.clauses.groupBy("pair_id").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES))


def versions_of_one(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (pair_id, before_id, after_id) whose agreements differ but have one root in ``lineage`` (contract_id, root)."""
    root = lambda name: lineage.select(F.col("contract_id").alias(f"{name}_id"), F.col("root").alias(f"_{name}"))
    joined = pairs.join(root("before").hint("merge"), "before_id").join(root("after").hint("merge"), "after_id")
    return joined.where((F.col("before_id") != F.col("after_id")) & (F.col("_before") == F.col("_after"))).select(pairs.columns)


def compare_agreements(clauses: DataFrame, pairs: DataFrame, preferences: dict | None = None, inflation: float = 0.0) -> Comparison:
    """The comparison of each pair (pair_id, before_id, after_id) of agreements in ``clauses`` (see ``analyses``).

    An agreement that several pairs name is analysed once. One that the identifier gate sets aside has no clauses here, so all clauses of
    its counterpart count as added or removed. Every step is keyed by contract_id or pair_id; pairs are independent.
    """
    named = settled(pairs.select("pair_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("contract_id")) for s in ("before", "after")))).alias("x")).select("pair_id", "x.*"))
    done = analyses.analyze(settled(clauses.join(named.select("contract_id").distinct().hint("merge"), "contract_id", "left_semi")), preferences)
    # ``at``: a clause's place in its version, as the alignment counts
    place = F.row_number().over(Window.partitionBy("contract_id").orderBy("ord")) - 1
    placed = settled(done.clauses.select("contract_id", "clause_id", "text", place.alias("at")))
    rows = settled(align.align(named.join(placed.hint("merge"), "contract_id").select("pair_id", "side", F.col("at").alias("ord"), "text")))
    found = done.findings.select("contract_id", "clause_id", "severity").join(placed.drop("text").hint("merge"), ["contract_id", "clause_id"])
    of = lambda side: named.where(F.col("side") == side).join(found.hint("merge"), "contract_id").select("pair_id", F.col("at").alias("ord"), "severity")
    statuses = analyses.compare(rows, of("before"), of("after"))
    protections = settled(named.join(done.protections.select("contract_id", "item", "status").hint("merge"), "contract_id").withColumn("key", F.struct("pair_id", "item")))
    both = full_outer_status(*(protections.where(F.col("side") == s).select("key", "status") for s in ("before", "after")), "key", "status")
    inputs = terms.schedule_inputs(done.terms()).withColumn("inflation", F.lit(inflation))
    total = schedule.totals(schedule.schedule(inputs, "contract_id"), "contract_id").select("contract_id", "total")
    costs = named.join(total.hint("merge"), "contract_id", "left").groupBy("pair_id").agg(*(F.max(F.when(F.col("side") == s, F.col("total"))).alias(f"cost_{s}") for s in ("before", "after")))
    return Comparison(statuses, both.select("key.*", "before", "after", "change"), costs)
