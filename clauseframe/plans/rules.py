"""Classification and rule tables.

A rule table is evaluated in order: flags accumulate, the last rule that holds gives the reason, and nothing after a
violation counts. Each row's verdict is a fold over one array, so that every condition is evaluated once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Rule:
    reason: str
    holds: Column
    flag: str


def severity(violates: Column, risk: Column, preference: Column) -> Column:
    """RED for a violation, ORANGE for a risk or a preference conflict, else OK; a null condition does not hold."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(violates), "RED").when(yes(risk) | yes(preference), "ORANGE").otherwise("OK")


def category(violates: Column, risk: Column, preference: Column) -> Column:
    return F.when(violates, "legal_violation").when(risk, "legal_risk").when(preference, "preference_conflict").otherwise("ok")


def overridden(override: Column, value: Column, verified: Column) -> tuple[Column, Column]:
    """(value, origin): the override, else the value if it is verified, else null."""
    trusted = F.when(verified, value)
    return F.coalesce(override, trusted), F.when(override.isNotNull(), "override").when(trusted.isNotNull(), "verified")


def evaluate(df: DataFrame, rules: list[Rule], flags: tuple[str, ...], violation: str = "violates", reason: str = "reason") -> DataFrame:
    """``df`` with a boolean column for each flag, and the reason. Conditions are plain columns of one row, so nothing is collected: the first
    violation gives the reason, else the last rule that holds."""
    held = [(r, F.coalesce(r.holds, F.lit(False))) for r in rules]
    violated = [(r, c) for r, c in held if r.flag == violation]
    out = df.withColumns({f"_h{i}": c for i, (_, c) in enumerate(held)})
    own = {id(r): F.col(f"_h{i}") for i, (r, _) in enumerate(held)}
    some = lambda rows: reduce(lambda a, b: a | b, (own[id(r)] for r in rows), F.lit(False))
    breach = some([r for r, _ in violated])
    # a violation hides the softer flags of the rules before it, and nothing after it counts
    said = {f: breach if f == violation else some([r for r, _ in held if r.flag == f]) & ~breach for f in flags}
    first = F.coalesce(*(F.when(own[id(r)], r.reason) for r, _ in violated), *(F.when(own[id(r)], r.reason) for r, _ in reversed(held)), F.lit(None).cast("string"))
    return out.withColumns(said | {reason: first}).drop(*(f"_h{i}" for i in range(len(held))))


def security_cap(rent: Column, months: Column, security: Column) -> dict[str, Column]:
    """The limit on a security: the smaller of a third of the whole rent and three months' rent. Without a term it is only
    decided when three months' rent is exceeded."""
    cap = F.when(months.isNotNull(), F.least(rent * months / 3, rent * 3)).otherwise(rent * 3)
    passed = F.when(security > cap, F.lit(False)).when(months.isNotNull(), F.lit(True))
    return {"cap": cap, "difference": F.greatest(security - cap, F.lit(0.0)), "passed": passed}


def urgent_repair(days: Column, most: int = 3) -> Column:
    return days <= most


@dataclass(frozen=True)
class Item:
    """A protection: patterns that cover it, that mention it, and that veto cover."""

    item: str
    covered: str
    partial: str
    excluded: str | None = None


def hits(text: Column | str, items: list[Item]) -> Column:
    """array<struct<item, covered, partial>>: what a text says of each protection."""
    one = lambda i: F.struct(F.lit(i.item).alias("item"), (T.holds(text, i.covered) & (~T.holds(text, i.excluded) if i.excluded else F.lit(True))).alias("covered"), T.holds(text, i.partial).alias("partial"))
    return F.array(*map(one, items))


def checklist(parts: DataFrame, items: list[Item], key: str, text: str = "text", part: str = "ord") -> DataFrame:
    """(key, item, status, parts): COVERED where a part matches the item's pattern and not its veto, else PARTIAL, else MISSING.

    The patterns are literals: each part gives one array of matches, and only matches are grouped. Parts that have ``hits`` are not read again.
    """
    found = F.col("hits") if "hits" in parts.columns else hits(text, items)
    rows = parts.select(key, part, F.explode(found).alias("hit")).select(key, part, "hit.*")
    # what only tells the status costs no lists if nobody asks for ``parts``
    names = ("covered", "partial")
    lists = (F.sort_array(F.collect_list(F.when(F.col(c), F.col(part)))).alias(c) for c in names)
    found = rows.groupBy(key, "item").agg(*lists, *(F.bool_or(F.col(c) & F.col(part).isNotNull()).alias(f"is_{c}") for c in names))
    status = F.when(F.col("is_covered"), "COVERED").when(F.col("is_partial"), "PARTIAL").otherwise("MISSING")
    return found.select(key, "item", status.alias("status"), F.when(F.col("is_covered"), F.col("covered")).otherwise(F.col("partial")).alias("parts"))
