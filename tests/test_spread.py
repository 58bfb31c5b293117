"""Queries that make much of a file of keys: what they do does not follow from the file's size."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def plans(spark, name, monkeypatch):
    """The plans of the query and of all that it settles."""
    told, kind = io.StringIO(), type(spark.range(1))
    kept = kind.checkpoint

    def checkpoint(df, *args, **more):
        df.explain()
        return kept(df, *args, **more)

    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    with contextlib.redirect_stdout(told):
        entry.queries()[name](spark, SMALL).explain()
    return told.getvalue()


@pytest.mark.parametrize("name", ["agreement_facts", "agreement_terms", "statute_history", "agreement_alignment"])
def test_what_grows_with_the_keys_is_not_sent_through_the_driver(spark, monkeypatch, name):
    assert "BroadcastExchange" not in plans(spark, name, monkeypatch)


@pytest.mark.parametrize("name", ["agreement_protections", "statute_chunks", "clause_chunks"])
def test_a_small_file_of_keys_is_dealt_over_all_cores(spark, monkeypatch, name):
    assert f", {4 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plans(spark, name, monkeypatch)


def test_facts_are_read_where_the_sentence_stands(spark):
    from clauseframe.plans import clauses as C
    from clauseframe.queries.agreements import agreements

    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        C.sentence_facts(C.with_sentences(agreements(spark, SMALL))).explain()
    assert "Join" not in told.getvalue() and told.getvalue().count("Exchange") == 1  # the one that deals the keys


def test_an_agreement_s_candidates_meet_once(spark):
    from clauseframe.plans import links
    from clauseframe.queries.agreements import agreements

    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        links.candidates(agreements(spark, SMALL)).explain()
    assert "Join" not in told.getvalue() and told.getvalue().count("Exchange hashpartitioning(contract_id") == 1


@pytest.mark.parametrize("text,kind,value", [("1 day", "days", 1.0), ("3 WEEKS", "days", 21.0), ("two 12 hour", "days", 0.5), ("שבוע", "days", 7.0), ("שנה אחת", "months", 12.0), ("5 percent", "percent", 5.0), ("7 ימי עבודה", "days", 7.0), ("NIS 1,200", "money", 1200.0)])
def test_a_number_is_not_passed_over(spark, text, kind, value):
    from clauseframe.plans import clauses as C

    df = spark.createDataFrame([(1, "C1", 0, 0, text)], "contract_id int, clause_id string, ord int, s_ord int, sentence string")
    assert (kind, value) in {(r.kind, r.value) for r in C.sentence_numbers(df).collect()}


def test_the_gate_reads_each_text_once(spark):
    from clauseframe.plans import redact

    df = spark.createDataFrame([(1, "call 052-1234567"), (1, "b"), (2, "c"), (None, "052-1234567"), (3, None)], "doc_id int, text string")
    clean, held = redact.gate(df)
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        clean.explain()
    assert "Join" not in told.getvalue() and told.getvalue().count("Exchange") == 1
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == [(0, "052-1234567"), (2, "c"), (3, "")]
    assert sorted(r.text for r in held.collect()) == ["b", "call 052-1234567"]
