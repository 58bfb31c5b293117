"""The state of negotiations, moved on by tools: which tool may be used when, what it changes, and what it refuses, as a fold over a
batch of calls or over a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from itertools import groupby
from operator import attrgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .replay import in_order

CALL = "negotiation_id long, at timestamp, seq long, tool string, issue string, issues array<string>, kind string, text string, confirmed boolean, conceded boolean"
RESULT = "negotiation_id long, at timestamp, seq long, tool string, outcome string, state string, priorities array<string>, decided int, draft string"
#: States, and the tools of each. Fixed values.
TALKING = ("PRIORITIZE", "STRATEGY", "DRAFT")
EVERY = (*TALKING, "COUNTER", "DONE")
TOOLS = {
    "set_address_form": TALKING, "set_priorities": TALKING, "add_tenant_issue": TALKING, "record_strategy": ("STRATEGY", "DRAFT"), "submit_draft": ("DRAFT",), "finalize_draft": ("DRAFT",),
    "complete_negotiation": ("COUNTER",), "get_issue_details": EVERY, "offer_quick_replies": EVERY,
}
FORMS, KINDS = ("MASCULINE", "FEMININE", "PLURAL"), ("CITE_LAW", "PROPOSE_ALTERNATIVE", "CONCEDE")
MOST_PRIORITIES, MOST_DRAFT = 30, 3000
IDLE = timedelta(days=30)


@dataclass(frozen=True)
class Negotiation:
    """``issues`` in the order in which they came up; ``plan``: issue -> kind of strategy."""

    state: str = "PRIORITIZE"
    form: str | None = None
    issues: tuple[str, ...] = ()
    priorities: tuple[str, ...] = ()
    plan: dict[str, str] = field(default_factory=dict)
    draft: str | None = None
    last: datetime | None = None


Move = tuple[Negotiation, str]


def planned(n: Negotiation) -> Negotiation:
    """Another plan makes a draft stale; once every priority is decided the message can be written."""
    return replace(n, draft=None, state="DRAFT" if all(i in n.plan for i in n.priorities) else "STRATEGY")


def prioritized(n: Negotiation, call: Any) -> Move:
    wanted = tuple(call.issues if call.issues is not None else ())
    if n.form is None:
        return n, "NO_ADDRESS_FORM"
    if not 0 < len(wanted) <= MOST_PRIORITIES or len(set(wanted)) < len(wanted):
        return n, "BAD_INPUT"
    if not set(wanted) <= set(n.issues):
        return n, "UNKNOWN_ISSUE"
    return planned(replace(n, priorities=wanted, plan={i: k for i, k in n.plan.items() if i in wanted})), "SAVED"


def raised(n: Negotiation, call: Any) -> Move:
    if not 2 <= len((call.text or "").strip()) <= 500:
        return n, "BAD_INPUT"
    own = f"tenant-{1 + sum(i.startswith('tenant-') for i in n.issues)}"
    more = replace(n, issues=(*n.issues, own))
    return (more if n.state == "PRIORITIZE" else planned(replace(more, priorities=(*n.priorities, own)))), "SAVED"


def decided(n: Negotiation, call: Any) -> Move:
    if call.kind not in KINDS:
        return n, "BAD_INPUT"
    if not call.confirmed:
        return n, "NOT_CONFIRMED"
    if call.issue not in n.priorities:
        return n, "UNKNOWN_ISSUE"
    if call.kind == "CONCEDE" and not call.conceded:
        return n, "CONCESSION_NOT_CONFIRMED"
    if call.kind != "CONCEDE" and not (call.text or "").strip():
        return n, "NO_REQUEST"
    return planned(replace(n, plan=n.plan | {call.issue: call.kind})), "SAVED"


def drafted(n: Negotiation, call: Any) -> Move:
    """A draft raises exactly what was not conceded."""
    text, named = (call.text or "").strip(), set(call.issues if call.issues is not None else ())
    if not 0 < len(text) <= MOST_DRAFT:
        return n, "BAD_INPUT"
    if named != {i for i in n.priorities if n.plan[i] != "CONCEDE"}:
        return n, "WRONG_REQUESTS"
    return replace(n, draft=text), "SAVED"


HANDLERS: dict[str, Callable[[Negotiation, Any], Move]] = {
    "set_address_form": lambda n, call: (replace(n, form=call.kind), "SAVED") if call.kind in FORMS else (n, "BAD_INPUT"),
    "set_priorities": prioritized,
    "add_tenant_issue": raised,
    "record_strategy": decided,
    "submit_draft": drafted,
    "finalize_draft": lambda n, _: (replace(n, state="COUNTER"), "SAVED") if n.draft else (n, "NO_DRAFT"),
    "complete_negotiation": lambda n, _: (replace(n, state="DONE"), "SAVED"),
    "get_issue_details": lambda n, call: (n, "SHOWN" if call.issue in n.issues else "UNKNOWN_ISSUE"),
    "offer_quick_replies": lambda n, call: (n, "SHOWN" if call.issues is None or len(call.issues) <= 4 else "BAD_INPUT"),
}


def called(n: Negotiation, call: Any) -> Move:
    """The negotiation after ``call`` (a row of ``CALL``), and what came of it; a refused call changes nothing. ``open`` lists the issues of an
    analysis, once."""
    if call.tool == "open":
        after, outcome = (replace(n, issues=tuple(call.issues if call.issues is not None else ())), "SAVED") if not n.issues else (n, "ALREADY_OPEN")
    elif call.tool not in TOOLS:
        after, outcome = n, "UNKNOWN_TOOL"
    elif n.state not in TOOLS[call.tool]:
        after, outcome = n, "NOT_AVAILABLE"
    else:
        after, outcome = HANDLERS[call.tool](n, call)
    return replace(after, last=call.at), outcome


def run(n: Negotiation, calls: pd.DataFrame) -> tuple[Negotiation, list[tuple]]:
    calls = calls.sort_values(["at", "seq"], kind="stable").astype(object)
    rows = []
    for call in calls.where(calls.notna(), None).itertuples():
        n, outcome = called(n, call)
        rows.append((call.negotiation_id, call.at, call.seq, call.tool, outcome, n.state, list(n.priorities), len(n.plan), n.draft))
    return n, rows


COLUMNS = ["negotiation_id", "at", "seq", "tool", "outcome", "state", "priorities", "decided", "draft"]


def replayed(calls: DataFrame) -> DataFrame:
    """What came of every call of a batch, in order. A negotiation's calls stand together, and one is followed by another: it has one state
    after another."""

    def follow(rows: Iterator[Any]) -> Iterator[tuple]:
        for _, own in groupby(rows, attrgetter("negotiation_id")):
            n = Negotiation()
            for call in own:
                n, outcome = called(n, call)
                yield call.negotiation_id, call.at, call.seq, call.tool, outcome, n.state, list(n.priorities), len(n.plan), n.draft

    return in_order(calls, "negotiation_id", follow, RESULT)


class Talks(StatefulProcessor):
    """One value for where a negotiation stands, lists for its issues and priorities, a map for the plan, and a timer that lets an idle one go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stands = handle.getValueState("stands", "state string, form string, draft string, last timestamp")
        self.issues, self.priorities = (handle.getListState(name, "issue string") for name in ("issues", "priorities"))
        self.plan = handle.getMapState("plan", "issue string", "kind string")

    def read(self) -> Negotiation:
        if not self.stands.exists():
            return Negotiation()
        state, form, draft, last = self.stands.get()
        listed = lambda own: tuple(i for (i,) in own.get())
        return Negotiation(state, form, listed(self.issues), listed(self.priorities), {i: k for (i,), (k,) in self.plan.iterator()}, draft, last)

    def write(self, n: Negotiation) -> None:
        self.stands.update((n.state, n.form, n.draft, n.last))
        for own, values in ((self.issues, n.issues), (self.priorities, n.priorities)):
            own.clear()
            if values:
                own.put([(i,) for i in values])
        self.plan.clear()
        for i, k in n.plan.items():
            self.plan.updateValue((i,), (k,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int((n.last + IDLE).timestamp() * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, out = run(self.read(), pd.concat(list(rows)))
        self.write(n)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n = self.read()
        for own in (self.stands, self.issues, self.priorities, self.plan):
            own.clear()
        yield pd.DataFrame([(key[0], n.last + IDLE, -1, "expire", "EXPIRED", n.state, list(n.priorities), len(n.plan), n.draft)], columns=COLUMNS)

    def close(self) -> None:
        pass


def negotiated(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """``replayed`` as a stream; a negotiation in which nothing happens for ``IDLE`` of event time is let go with a last row, seq -1. The
    session keeps state in RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    return calls.withWatermark("at", late).groupBy("negotiation_id").transformWithStateInPandas(Talks(), RESULT, "Append", "EventTime")
