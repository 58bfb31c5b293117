"""Negotiations, lookups and renumbered sections on small inputs of our own; the registered queries are held to their SQL in test_core."""

import datetime

import pytest
from pyspark.sql import functions as F

from clauseframe.functions import numbers as N
from clauseframe.operators import repository as P
from clauseframe.plans import align, negotiations


def test_renumbered_sections():
    labels = {"9": "8", "5.2": "4.1", "5": "4"}
    assert align.renumbered("subject to section 9 and sections 5.2, 5.3-7", labels) == "subject to section 8 and sections 4.1, 4.3-7"
    assert align.renumbered("בכפוף לסעיף 9 ולסעיפים 5 ו-9 בתוך 9 ימים", labels) == "בכפוף לסעיף 8 ולסעיפים 4 ו-8 בתוך 9 ימים"
    assert align.renumbered(None, labels) == "" and align.renumbered("9 days", labels) == "9 days"


def test_a_clause_that_only_follows_a_renumbering_is_unchanged():
    before = ["1. The rent is due on the first.", "2. The rent of section 1 includes water.", "3. Pets as in section 2 are not allowed in 2 rooms."]
    after = ["1. Parking is at the back of the house.", "2. The rent is due on the first.", "3. The rent of section 2 includes water.", "4. Pets as in section 2 are not allowed in 2 rooms."]
    rows = {tuple(y): (x, c, r) for x, y, c, _, _, r in align.aligned(before, after)}
    assert rows[(1,)] == ([0], "UNCHANGED", False) and rows[(2,)] == ([1], "UNCHANGED", True)
    assert rows[(3,)] == ([2], "UNCHANGED", False)  # word for word the same, as the first rule has it
    assert rows[(0,)] == ([], "ADDED", False)
    after[3] = "4. Pets as in section 3 are not allowed in 3 rooms."
    assert {tuple(y): (c, r) for _, y, c, _, _, r in align.aligned(before, after)}[(3,)] == ("MODIFIED", False)


def test_preferences_follow_the_topic(spark):
    issues = spark.createDataFrame([(1, "a", "rent"), (1, "b", "other"), (2, "c", "rent"), (1, "d", None)], "contract_id int, issue_id string, topic string")
    lines = spark.createDataFrame([(1, "max", "at most 5"), (1, "pets", "a cat"), (1, "notes", "quiet")], "contract_id int, key string, line string")
    got = sorted((r.issue_id, r.key) for r in negotiations.preferences_for(issues, lines, {"rent": ("max", "notes")}).collect())
    assert got == [("a", "max"), ("a", "notes"), ("b", "notes"), ("d", "notes")]


def test_sources_of_a_draft(spark):
    requests = spark.createDataFrame([(1, "a", ["r2", "r1", "r2", "zz"]), (1, "b", ["r1"]), (1, "c", None)], "draft_id int, issue_id string, law_refs array<string>")
    refs = spark.createDataFrame([(1, "a", "r1", 1, "5"), (1, "a", "r2", 0, "7"), (1, "a", "r3", 2, "8"), (1, "c", "r1", 0, "5")], "draft_id int, issue_id string, ref_id string, ord int, section string")
    assert [(r.issue_id, [tuple(x) for x in r.refs]) for r in negotiations.draft_sources(requests, refs).collect()] == [("a", [("r2", "7"), ("r1", "5")])]


def test_replies_and_citations(spark):
    kind = "contract_id int, issue_id string, reply string, answer string, law array<string>, contract array<string>, grounded array<string>"
    rows = [(1, "a", "no", "18 days", [], [], ["18"]), (1, "a", "no", "19 days", [], [], ["18"]), (1, "b", "no", "yes", [], [], []), (1, None, "hello", None, [], [], [])]
    raised = spark.createDataFrame([(1, "a"), (1, "a")], "contract_id int, issue_id string")
    got = negotiations.usable_replies(spark.createDataFrame(rows, kind), raised).collect()
    assert sorted((r.issue_id or "", r.answer or "") for r in got) == [("", ""), ("a", "18 days")]
    cited = spark.createDataFrame([(1, ["x", "y"], ["y"]), (2, ["x"], ["y"]), (3, None, ["y"])], "id int, cited array<string>, allowed array<string>")
    assert [(r.id, r.cited) for r in negotiations.allowed_only(cited, "cited", "allowed").collect()] == [(1, ["y"])]


def test_context_masks_clauses_and_notes(spark):
    clauses = spark.createDataFrame([(1, 0, "C1", "כתבו אל dana@example.com"), (1, 1, "C2", "12/5"), (1, 2, "C3", None)], "contract_id int, ord int, clause_id string, text string")
    notes = spark.createDataFrame([(1, "my mail is a.b@example.org"), (2, None)], "contract_id int, text string")
    got = negotiations.context(clauses, notes).orderBy("contract_id", "ord").collect()
    assert [(r.contract_id, r.ord, r.clause_id) for r in got] == [(1, -1, None), (1, 0, "C1")]
    assert not any("@" in r.text for r in got)


def test_lookups_and_fields(spark):
    chunks = spark.createDataFrame([(1, 0, "h", "a"), (1, 1, "h", "b"), (1, 2, "k", "c")], "v int, at int, hash string, body string")
    records = spark.createDataFrame([(1, 1, "h"), (1, 0, "k"), (1, 5, "h"), (1, None, "k"), (2, 0, "h")], "v int, at int, hash string")
    got = {(r.v, r.at, r.hash): (r.body, r.found_by) for r in P.hydrated(records, chunks, "v", "at", ["hash"], "body").collect()}
    assert got == {(1, 1, "h"): ("b", "PLACE"), (1, 0, "k"): ("c", "IDENTITY"), (1, 5, "h"): (None, None), (1, None, "k"): ("c", "IDENTITY"), (2, 0, "h"): (None, None)}
    with pytest.raises(Exception, match="no longer in its source"):
        P.hydrated(records, chunks, "v", "at", ["hash"], "body", strict=True).collect()
    with pytest.raises(ValueError, match="no such columns: gone"):
        P.public(records, "gone")
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    keys = [r.key for r in t.union(t.where("id = 1")).select(P.content_key("1", "id", "x").alias("key")).collect()]
    assert keys[0] == keys[2] != keys[1] and t.select(P.content_key("2", "id", "x").alias("key")).first().key != keys[0]


def test_date_in_zone(spark):
    at = datetime.datetime(2024, 1, 31, 22, 30)
    row = spark.range(1).select(N.date_in_zone(F.to_timestamp_ntz(F.lit(str(at)))).alias("d"), N.date_in_zone(F.to_timestamp_ntz(F.lit("2024-01-31 21:59:00"))).alias("e")).first()
    assert (str(row.d), str(row.e)) == ("2024-02-01", "2024-01-31")
