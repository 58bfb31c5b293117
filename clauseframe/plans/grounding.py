"""Whether a drafted message keeps to what is known: its numbers, the sections it names, the issues it raises.

Problems are codes in an array column, so that a batch of drafts is one narrow pass over rows that hold what they are checked against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import numbers_in

#: Fixed patterns.
SECTION = r"סעיף\s+(\d+(?:\.\d+)*[א-ת]{0,2}(?:\s*\([^)\s]{1,4}\))*)"
PLACEHOLDER, LINK, HEBREW, LAW = r"\[[A-Z_]{3,}\]", r"(?i)https?://|www\.|@[a-z0-9-]+\.", r"\p{IsHebrew}", "חוק"
LEAST = 60


def normal_section(section: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(section, r"^סעיף\s*", ""), r"\([^)]*\)", ""), r"[\"'״׳\s]", "")


def sections_named(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SECTION), F.lit(1)), normal_section))


def loose_numbers(text: Column, grounded: Column) -> Column:
    """Numbers of the text, section numbers aside, that ``grounded`` (array of numbers as text) lacks."""
    return F.array_except(numbers_in(F.regexp_replace(text, SECTION, "")), grounded)


def loose_sections(text: Column, law: Column, contract: Column) -> Column:
    """Sections that are neither a cited one of the law nor, by itself or as a part, one of the agreement."""
    known = lambda m: F.array_contains(law, m) | F.exists(contract, lambda c: (m == c) | F.startswith(m, F.concat(c, F.lit("."))))
    return F.filter(sections_named(text), lambda m: ~known(m))


def text_problems(text: Column, law: Column, contract: Column, grounded: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.rlike(text, F.lit(PLACEHOLDER)), F.lit("PLACEHOLDER")), F.when(F.rlike(text, F.lit(LINK)), F.lit("LINK")),
            F.when(F.size(loose_sections(text, law, contract)) > 0, F.lit("UNKNOWN_SECTION")), F.when(F.size(loose_numbers(text, grounded)) > 0, F.lit("LOOSE_NUMBER")),
        )
    )


def draft_problems(drafts: DataFrame) -> DataFrame:
    """``drafts`` with ``problems``.

    A draft has text, requests array<struct<issue_id, law_refs array<string>>>, issues array<struct<issue_id, section, refs
    array<struct<id, section>>, strategy, request>> (those the tenant raises) and known array<string> of texts that may be quoted.
    """
    ids = F.transform("issues", lambda i: i["issue_id"])
    asked = F.transform("requests", lambda r: r["issue_id"])
    own = lambda r: F.get(F.filter("issues", lambda i: i["issue_id"] == r["issue_id"]), F.lit(0))
    cited = F.flatten(F.transform("requests", lambda r: F.filter(F.coalesce(own(r)["refs"], F.array()), lambda x: F.array_contains(r["law_refs"], x["id"]))))
    foreign = F.exists("requests", lambda r: own(r).isNotNull() & (F.size(F.array_except(r["law_refs"], F.transform(own(r)["refs"], lambda x: x["id"]))) > 0))
    uncited = F.exists("requests", lambda r: (own(r)["strategy"] == "CITE_LAW") & (F.size(r["law_refs"]) == 0))
    said = numbers_in(F.regexp_replace("text", SECTION, ""))
    dropped = F.exists("issues", lambda i: F.size(F.array_except(numbers_in(F.regexp_replace(F.coalesce(i["request"], F.lit("")), SECTION, "")), said)) > 0)
    grounded = F.array_distinct(F.flatten(F.transform("known", numbers_in)))
    law = F.transform(F.filter(cited, lambda x: x["section"].isNotNull()), lambda x: normal_section(x["section"]))
    contract = F.filter(F.transform("issues", lambda i: i["section"]), lambda s: s.isNotNull())
    flag = lambda c, code: F.when(F.coalesce(c, F.lit(False)), F.lit(code))
    structure = F.array_compact(
        F.array(
            flag(F.size(asked) > F.size(F.array_distinct(asked)), "ISSUE_TWICE"), flag(F.size(F.array_except(asked, ids)) > 0, "ISSUE_NOT_RAISED"), flag(F.size(F.array_except(ids, asked)) > 0, "ISSUE_LEFT_OUT"),
            flag(foreign, "FOREIGN_REFERENCE"), flag(uncited, "UNCITED"), flag(dropped, "FIGURE_DROPPED"), flag(~F.rlike("text", F.lit(HEBREW)), "NOT_HEBREW"), flag(F.length(F.trim("text")) < LEAST, "TOO_SHORT"),
            flag(F.contains("text", F.lit(LAW)) & (F.size(cited) == 0), "LAW_WITHOUT_CITATION"),
        )
    )
    return drafts.withColumn("problems", F.concat(structure, text_problems(F.col("text"), law, contract, grounded)))


def strategy_problems(rows: DataFrame) -> DataFrame:
    """``rows`` (severity, has_reference, prioritised, kind, request, confirmed) with ``problems``."""
    asks = F.col("kind") != "CONCEDE"
    problem = F.when(~F.col("prioritised"), F.array(F.lit("NOT_A_PRIORITY"))).otherwise(
        F.array_compact(
            F.array(
                F.when((F.col("kind") == "CITE_LAW") & ~F.col("has_reference"), F.lit("NO_REFERENCE")),
                F.when(~asks & (F.col("severity") == "RED") & ~F.col("confirmed"), F.lit("CONFIRMATION_NEEDED")),
                F.when(asks & ~F.coalesce(F.rlike("request", F.lit(HEBREW)), F.lit(False)), F.lit("NO_REQUEST")),
            )
        )
    )
    return rows.withColumn("problems", problem)
