"""What a negotiation is prepared from: the wishes that bear on each issue, the sources behind a draft, the replies that may be shown.

Frames are keyed by contract_id; a null text counts as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import status_counts
from . import grounding, redact, segment

OPENING = ("RED", "ORANGE", "SUGGESTION")


def preferences_for(issues: DataFrame, preferences: DataFrame, topics: dict[str, tuple[str, ...]], always: tuple[str, ...] = ("notes",)) -> DataFrame:
    """(contract_id, issue_id, key, line): the lines of ``preferences`` (contract_id, key, line) that bear on the topic of each of
    ``issues`` (contract_id, issue_id, topic). ``topics`` names the keys of a topic; those in ``always`` go with every one."""
    names = lambda keys: F.array(*map(F.lit, keys)).cast("array<string>")
    own = names(())
    for topic, keys in topics.items():
        own = F.when(F.col("topic") == topic, names(keys)).otherwise(own)
    wanted = issues.select("contract_id", "issue_id", F.explode(F.array_union(own, names(always))).alias("key"))
    return wanted.join(preferences.select("contract_id", "key", "line"), ["contract_id", "key"]).select("contract_id", "issue_id", "key", "line")


def draft_sources(requests: DataFrame, references: DataFrame) -> DataFrame:
    """(draft_id, issue_id, refs): for each request (draft_id, issue_id, law_refs array) those ``references`` (draft_id, issue_id,
    ref_id, ord, …) of its issue that it cites, in their own order. A request that cites none of them has no row."""
    cited = requests.select("draft_id", "issue_id", F.explode("law_refs").alias("ref_id")).distinct()
    found = references.join(cited, ["draft_id", "issue_id", "ref_id"])
    rest = [c for c in references.columns if c not in ("draft_id", "issue_id", "ord")]
    return found.groupBy("draft_id", "issue_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", *rest))), lambda r: r.dropFields("ord")).alias("refs"))


def opening_counts(issues: DataFrame) -> DataFrame:
    """(contract_id, n_red, n_orange, n_suggestion) of the issues that an opening message names."""
    return issues.groupBy("contract_id").agg(*status_counts("severity", OPENING))


def allowed_only(issues: DataFrame, cited: str, allowed: str) -> DataFrame:
    """``issues`` whose array ``cited`` keeps only what ``allowed`` holds; those left with nothing go, as do null arrays."""
    return issues.withColumn(cited, F.array_intersect(cited, allowed)).where(F.size(cited) > 0)


def usable_replies(replies: DataFrame, raised: DataFrame) -> DataFrame:
    """Those ``replies`` (contract_id, issue_id, reply, answer, law, contract, grounded) that speak of an issue in ``raised``
    (contract_id, issue_id), or of none in particular, and name no number or section beyond what the arrays ground."""
    own = raised.select("contract_id", "issue_id").distinct().withColumn("_raised", F.lit(True))
    text = F.concat_ws("\n", "reply", "answer")
    sound = F.size(grounding.text_problems(text, F.col("law"), F.col("contract"), F.col("grounded"))) == 0
    told = replies.join(own, ["contract_id", "issue_id"], "left").where((F.col("issue_id").isNull() | F.col("_raised")) & sound)
    return told.select(*replies.columns)


def context(clauses: DataFrame, notes: DataFrame, rules: tuple[redact.Rule, ...] = redact.HEBREW) -> DataFrame:
    """(contract_id, ord, clause_id, text): the clauses that say something and the tenant's ``notes`` (contract_id, text; ord -1, no
    clause_id), with identifiers masked in one pass over both."""
    told = clauses.where(~segment.is_junk("text") & (F.length(F.trim("text")) > 0)).select("contract_id", "ord", "clause_id", "text")
    own = notes.where(F.length(F.trim("text")) > 0).select("contract_id", F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("clause_id"), "text")
    return redact.redact(told.unionByName(own), rules).select("contract_id", "ord", "clause_id", "text")
