"""Patterns are tried only on texts that hold what they need, and a checklist's status costs no lists."""

import contextlib
import io

import pytest

from clauseframe.functions import text as T
from clauseframe.lexicon import hebrew as H
from clauseframe.lexicon import phrases as P
from clauseframe.lexicon import verdicts as V
from clauseframe.plans import rules
from clauseframe.queries.agreements import CLAUSES, RULED

PATTERNS = {f"{i}/{n}": p for i, *found in H.PROTECTIONS for n, p in enumerate(found) if p} | dict(H.CONCEPTS) | {k: p for k, p in vars(V).items() if isinstance(p, P.Pattern)}
TEXTS = [*CLAUSES, *(t for t, *_ in RULED), "RENT and DEPOSIT", "Urgent Repair", "השוכר רשאי לסיים בסיום\nמוקדם", "להחזיר את הפיקדון", "השבת הערבות", "", None]


def test_all_protections_tell_what_they_need():
    assert all(p.needs for _, *found in H.PROTECTIONS for p in found if p)


@pytest.mark.parametrize("pattern,needs", [
    (P.any_of("1 2", "1 3*"), ("1", "2|3")), (P.any_of("a"), ("(?iu:a)",)), (P.either(P.any_of("1"), r"\d"), ()), (P.either(P.any_of("1"), P.any_of("2")), ("1|2",)),
    (P.then(P.any_of("1"), P.any_of("2")), ("1", "2")), (P.any_of('ש"ח'), ("ש",)), (P.any_of('"'), ()), (P.one_sentence(r"\d", P.any_of("2*")), ("2",)),
])
def test_needs(pattern, needs):
    assert pattern.needs == needs


def test_a_need_passes_over_no_match(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    one = lambda k, p: F.struct(F.lit(k).alias("k"), T.holds("text", p).alias("a"), F.rlike("text", F.lit(str(p))).alias("b"))
    rows = df.select("text", F.inline(F.array(*(one(k, p) for k, p in PATTERNS.items())))).collect()
    assert sum(bool(r.b) for r in rows) > 60 and [r for r in rows if r.a != r.b] == []


def test_a_status_costs_no_lists(spark):
    df = spark.createDataFrame([(1, 0, "1"), (1, 1, "2"), (1, None, "3"), (2, 0, None)], "key int, ord int, text string")
    found = rules.checklist(df, [rules.Item("x", "1", "2"), rules.Item("y", "3", "2"), rules.Item("z", "3", "3")], "key")
    assert {(r.key, r.item): (r.status, r.parts) for r in found.collect()} == {
        (1, "x"): ("COVERED", [0]), (1, "y"): ("PARTIAL", [1]), (1, "z"): ("MISSING", []), (2, "x"): ("MISSING", []), (2, "y"): ("MISSING", []), (2, "z"): ("MISSING", []),
    }
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        found.select("key", "item", "status").explain()
    assert "collect_list" not in told.getvalue() and "ObjectHashAggregate" not in told.getvalue()
