"""The analysis of agreements as one plan, and the comparison of two analyses.

``clauses`` are (contract_id, ord, clause_id, text, section_label, heading). Any number of agreements is analysed at once; every
step is keyed by contract_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lexicon import hebrew as H
from ..operators.aggregates import status_counts
from ..operators.ranking import SEVERITIES, rank_of
from ..session import settled
from . import clauses as C
from . import links, redact, report, rules, terms, verdicts

STATUSES = ("COVERED", "PARTIAL", "MISSING")


@dataclass(frozen=True)
class Analysis:
    """What is known of each agreement, one frame for each kind of result."""

    clauses: DataFrame
    quarantined: DataFrame
    links: DataFrame
    findings: DataFrame
    protections: DataFrame
    wordings: DataFrame

    def terms(self) -> DataFrame:
        """The money terms, read when they are asked for."""
        return terms.extract(C.with_readings(self.clauses, settled(terms.with_terms(self.wordings))))

    def overview(self) -> DataFrame:
        """(contract_id, red, orange, ok, covered, partial, missing): a row for each agreement that was analysed."""
        kept = self.clauses.select("contract_id").distinct()
        counted = self.protections.groupBy("contract_id").agg(*status_counts("status", STATUSES, ""))
        return kept.join(report.summary(self.findings).hint("merge"), "contract_id").join(counted.hint("merge"), "contract_id")


def analyze(clauses: DataFrame, preferences: dict | None = None, items: tuple = H.PROTECTIONS, least_chars: int = 1) -> Analysis:
    """Identifiers are redacted; an agreement in which one remains is set aside as a whole; of the others the clauses with text
    are linked, judged and checked for protections; ``terms()`` reads their money terms. A null text counts as none. What follows from a
    clause's words alone is read once for each wording, see ``clauses.worded``."""
    asked, protect = preferences or {}, [rules.Item(*i) for i in items]
    masked = lambda words: redact.redact(words, redact.HEBREW).drop("redactions").withColumn("_left", redact.residual("text", redact.HEBREW, redact.RESIDUAL))
    told = lambda read: links.with_told(verdicts.marked(read, asked).withColumn("hits", rules.hits("text", protect)))
    numbered, wordings = C.worded(clauses, masked, told)
    clean, held = redact.gate(numbered, key="contract_id")
    kept = settled(clean.where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= least_chars))
    read = C.with_readings(kept, wordings)
    graph = settled(links.link_clauses(read, texts=kept))
    judged = settled(verdicts.verdicts(read, graph, asked))
    protections = rules.checklist(read, protect, "contract_id", "text", "clause_id")
    return Analysis(kept, held, graph, report.findings(kept, judged), protections, wordings)


def comparison_status(change: Column, before: Column, after: Column) -> Column:
    """What a change means for a reader, from the worst severities before and after. Fixed table."""
    x, y = (3 - F.when(F.coalesce(s, F.lit("OK")) == "RED", 1).when(F.coalesce(s, F.lit("OK")) == "ORANGE", 2).otherwise(3) for s in (before, after))
    gone, new = (change == "REMOVED") | ((x > 0) & (y == 0)), (change == "ADDED") | ((y > 0) & (x == 0))
    return (
        F.when((change == "REMOVED") & (x == 0), "UNREQUESTED_CHANGE")
        .when((change == "ADDED") & (y == 0), "UNREQUESTED_CHANGE")
        .when(gone & (change != "ADDED"), "FIXED")
        .when(new, "NEW_ISSUE")
        .when(x > 0, F.when(y > x, "WORSENED").when(y < x, "IMPROVED").otherwise("STILL_OPEN"))
        .when(change == "UNCHANGED", "UNCHANGED")
        .otherwise("UNREQUESTED_CHANGE")
    )


def side(alignments: DataFrame, findings: DataFrame, ids: str, name: str) -> DataFrame:
    """(pair_id, at, name): the worst severity among the findings (pair_id, ord, severity) of the clauses that each alignment
    row names in the array ``ids``; null where it names none that has a finding."""
    named = alignments.select("pair_id", "at", F.explode(ids).alias("ord")).join(findings.hint("merge"), ["pair_id", "ord"])
    worst = F.min_by("severity", rank_of("severity", SEVERITIES)).alias(name)
    return named.groupBy("pair_id", "at").agg(worst)


def compare(alignments: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``alignments`` (pair_id, before, after, change, …) with severity_before, severity_after and status. ``before`` and ``after``
    are the findings (pair_id, ord, severity) of the two analyses; an alignment row is told by what it names on either side."""
    rows = alignments.withColumn("at", F.to_json(F.struct("before", "after")))
    joined = rows.join(side(rows, before, "before", "severity_before").hint("merge"), ["pair_id", "at"], "left").join(side(rows, after, "after", "severity_after").hint("merge"), ["pair_id", "at"], "left")
    return joined.withColumn("status", comparison_status(F.col("change"), F.col("severity_before"), F.col("severity_after"))).drop("at")
