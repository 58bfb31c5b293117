"""Negotiations moved on by tools: a table of sequences, a plain model on random calls, and a stream that equals the batch."""

import random
from datetime import datetime, timedelta

from clauseframe.streaming import negotiation as N

START = datetime(2026, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def call(key, seq, tool, issue=None, issues=None, kind=None, text=None, confirmed=None, conceded=None):
    return (key, START + timedelta(minutes=seq), seq, tool, issue, issues, kind, text, confirmed, conceded)


OPEN = ("open", None, ["a", "b"])
FORM = ("set_address_form", None, None, "PLURAL")
BOTH = ("set_priorities", None, ["b", "a"])
YES_A, YES_B = ("record_strategy", "a", None, "CITE_LAW", "please", True), ("record_strategy", "b", None, "CONCEDE", None, True, True)
DRAFT = ("submit_draft", None, ["a"], None, "Dear landlord")
#: a sequence of calls -> (outcome, state) of the last
TABLE = [
    ([OPEN], "SAVED", "PRIORITIZE"), ([OPEN, OPEN], "ALREADY_OPEN", "PRIORITIZE"), ([OPEN, BOTH], "NO_ADDRESS_FORM", "PRIORITIZE"), ([OPEN, FORM, BOTH], "SAVED", "STRATEGY"),
    ([OPEN, FORM, ("set_priorities", None, ["a", "a"])], "BAD_INPUT", "PRIORITIZE"), ([OPEN, FORM, ("set_priorities", None, ["c"])], "UNKNOWN_ISSUE", "PRIORITIZE"), ([OPEN, YES_A], "NOT_AVAILABLE", "PRIORITIZE"),
    ([OPEN, FORM, BOTH, ("record_strategy", "a", None, "CITE_LAW", "please", False)], "NOT_CONFIRMED", "STRATEGY"), ([OPEN, FORM, BOTH, ("record_strategy", "b", None, "CONCEDE", None, True, False)], "CONCESSION_NOT_CONFIRMED", "STRATEGY"),
    ([OPEN, FORM, BOTH, ("record_strategy", "a", None, "CITE_LAW", " ", True)], "NO_REQUEST", "STRATEGY"), ([OPEN, FORM, BOTH, YES_A], "SAVED", "STRATEGY"), ([OPEN, FORM, BOTH, YES_A, YES_B], "SAVED", "DRAFT"),
    ([OPEN, FORM, BOTH, YES_A, YES_B, ("finalize_draft",)], "NO_DRAFT", "DRAFT"), ([OPEN, FORM, BOTH, YES_A, YES_B, ("submit_draft", None, ["a", "b"], None, "x")], "WRONG_REQUESTS", "DRAFT"), ([OPEN, FORM, BOTH, YES_A, YES_B, DRAFT], "SAVED", "DRAFT"),
    ([OPEN, FORM, BOTH, YES_A, YES_B, DRAFT, YES_A, ("finalize_draft",)], "NO_DRAFT", "DRAFT"), ([OPEN, FORM, BOTH, YES_A, YES_B, DRAFT, ("finalize_draft",)], "SAVED", "COUNTER"),
    ([OPEN, FORM, BOTH, YES_A, YES_B, ("add_tenant_issue", None, None, None, "painting")], "SAVED", "STRATEGY"), ([OPEN, FORM, BOTH, YES_A, YES_B, DRAFT, ("finalize_draft",), FORM], "NOT_AVAILABLE", "COUNTER"),
    ([OPEN, FORM, BOTH, YES_A, YES_B, DRAFT, ("finalize_draft",), ("complete_negotiation",)], "SAVED", "DONE"), ([OPEN, ("complete_negotiation",)], "NOT_AVAILABLE", "PRIORITIZE"),
    ([OPEN, FORM, BOTH, YES_A, YES_B, DRAFT, ("finalize_draft",), ("complete_negotiation",), ("get_issue_details", "a")], "SHOWN", "DONE"), ([OPEN, ("get_issue_details", "z")], "UNKNOWN_ISSUE", "PRIORITIZE"), ([("fly",)], "UNKNOWN_TOOL", "PRIORITIZE"),
    ([OPEN, ("offer_quick_replies", None, list("abcde"))], "BAD_INPUT", "PRIORITIZE"), ([OPEN, FORM, BOTH, YES_A, ("set_priorities", None, ["a"])], "SAVED", "DRAFT"), ([OPEN, ("add_tenant_issue", None, None, None, "x")], "BAD_INPUT", "PRIORITIZE"),
]


def test_a_table_of_sequences(spark):
    rows = [call(k, seq, *c) for k, (calls, _, _) in enumerate(TABLE) for seq, c in enumerate(calls)]
    last = {}
    for r in N.replayed(spark.createDataFrame(rows, N.CALL)).orderBy("seq").collect():
        last[r.negotiation_id] = (r.outcome, r.state)
    assert last == {k: (outcome, state) for k, (_, outcome, state) in enumerate(TABLE)}


def random_calls(rng, key):
    some = [OPEN, FORM, BOTH, ("set_priorities", None, ["a"]), YES_A, YES_B, DRAFT, ("submit_draft", None, [], None, "none"), ("finalize_draft",), ("complete_negotiation",), ("add_tenant_issue", None, None, None, "painting")]
    some += [("record_strategy", "tenant-1", None, "PROPOSE_ALTERNATIVE", "half", True), ("record_strategy", "a", None, "CONCEDE", None, True, True), ("get_issue_details", "b")]
    calls = rng.choice(([], [OPEN, FORM, BOTH], [OPEN, FORM, BOTH, YES_A, YES_B, DRAFT], [OPEN, FORM, BOTH, YES_A, YES_B, DRAFT, ("finalize_draft",)]))
    return [call(key, seq, *c) for seq, c in enumerate(calls + rng.choices(some, k=rng.randrange(1, 14)))]


def test_invariants_and_a_stream_that_equals_the_batch(spark, tmp_path):
    rng = random.Random(8)
    calls = [c for key in range(60) for c in random_calls(rng, key)]
    rows = lambda frame: sorted((r.negotiation_id, r.seq, r.tool, r.outcome, r.state, tuple(r.priorities), r.decided, r.draft) for r in frame.collect())
    want = rows(N.replayed(spark.createDataFrame(calls, N.CALL)))
    assert len(want) == len(calls) and {"DONE", "COUNTER", "DRAFT", "STRATEGY"} <= {w[4] for w in want}
    moves = {"PRIORITIZE": {"PRIORITIZE", "STRATEGY"}, "STRATEGY": {"STRATEGY", "DRAFT"}, "DRAFT": {"DRAFT", "STRATEGY", "COUNTER"}, "COUNTER": {"COUNTER", "DONE"}, "DONE": {"DONE"}}
    before = {}
    for w in want:
        old = before.get(w[0], "PRIORITIZE")
        assert w[4] in moves[old] and (w[3] in ("SAVED", "SHOWN") or w[4] == old)
        assert w[4] != "DRAFT" or w[6] == len(w[5]) and (w[7] is None or w[4] in ("DRAFT", "COUNTER", "DONE"))
        assert w[4] != "STRATEGY" or w[6] < len(w[5]) and w[7] is None
        before[w[0]] = w[4]
    source = tmp_path / "calls"
    source.mkdir()
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = N.negotiated(spark.readStream.schema(N.CALL).parquet(str(source)))
        late = [call(999, 60 * 24 * 31, "open", None, ["z"]), call(999, 60 * 24 * 31 + 1, "get_issue_details", "z")]
        calls.sort(key=lambda c: (c[1], c[2]))
        for part in (calls[: len(calls) // 2], calls[len(calls) // 2 :], late[:1], late[1:]):
            spark.createDataFrame(part, N.CALL).coalesce(1).write.mode("append").parquet(str(source))
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = [r for r in rows(spark.read.schema(N.RESULT).parquet(str(tmp_path / "out"))) if r[0] != 999]
    assert [g for g in got if g[2] != "expire"] == want
    assert {g[0] for g in got if g[2] == "expire"} == set(range(60))
