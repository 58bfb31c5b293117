"""The state of monitored laws: what is in force, what waits for approval, and a log, as a fold over a batch of events or over a stream.

An event is a check of a law's sources, or somebody's approval of what was staged. A staged version that has settled comes into
force by itself if it passes ``approvable``; in a stream a timer sees to that when no later event does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from itertools import groupby
from operator import attrgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .replay import in_order

EVENT = (
    "law_id long, at timestamp, seq long, kind string, official string, revision long, content string, sections string, keys array<string>, "
    "approved_content string, approved_sections string, error string"
)
RESULT = "law_id long, at timestamp, seq long, outcome string, status string, active_revision long, candidate_revision long"
VERSION = "official string, revision long, content string, sections string, keys array<string>"
SETTLE = timedelta(hours=24)
LEAST_RETAINED = 0.9


@dataclass(frozen=True)
class Version:
    """What tells one wording of a law from another."""

    official: str
    revision: int
    content: str
    sections: str
    keys: tuple[str, ...] = ()

    @property
    def text(self) -> tuple[str, str]:
        return self.content, self.sections


@dataclass(frozen=True)
class Law:
    """``unmatched``: the candidate differs from the active wording although no official change says why."""

    active: Version | None = None
    candidate: Version | None = None
    unmatched: bool = False
    staged: datetime | None = None
    status: str = "UNKNOWN"


def approvable(law: Law) -> bool:
    """A settled candidate of an official change that keeps nearly all sections of what is in force."""
    if law.candidate is None or law.active is None or law.unmatched or not law.active.keys:
        return False
    return len(set(law.active.keys) & set(law.candidate.keys)) >= LEAST_RETAINED * len(set(law.active.keys))


def activated(law: Law) -> Law:
    return Law(law.candidate, None, False, None, "ACTIVE")


def settled_by(law: Law, now: datetime) -> tuple[Law, list[tuple[datetime, int, str]]]:
    """The law once what has settled by ``now`` is in force, and the log of that."""
    if law.staged is not None and law.staged + SETTLE <= now and approvable(law):
        return activated(law), [(law.staged + SETTLE, -1, "AUTO_APPROVED")]
    return law, []


def checked(law: Law, seen: Version, approved: tuple[str | None, str | None], at: datetime) -> tuple[Law, str]:
    """A check that has seen ``seen``; ``approved`` is the text of the active revision as it reads today."""
    active = law.active
    same_official, same_text = active is not None and active.official == seen.official, active is not None and active.text == seen.text
    if same_official and same_text:
        return replace(law, active=replace(active, keys=seen.keys), candidate=None, unmatched=False, staged=None, status="ACTIVE"), "UNCHANGED"
    waits = law.candidate
    if waits is not None and (waits.official, waits.revision, waits.content) == (seen.official, seen.revision, seen.content):
        return law, "UNCHANGED"
    unmatched = False
    if same_official and active.revision != seen.revision:
        unmatched = approved != seen.text
    elif active is not None and active.content == seen.content:
        return replace(law, candidate=None, unmatched=False, staged=None, status="OFFICIAL_UPDATE_PENDING"), "OFFICIAL_UPDATE_PENDING"
    return replace(law, candidate=seen, unmatched=unmatched, staged=at, status="TEXT_CHANGED" if unmatched else "AWAITING_APPROVAL"), "STAGED_UNMATCHED" if unmatched else "STAGED"


def folded(law: Law, event: Any) -> tuple[Law, list[tuple[datetime, int, str]]]:
    """The law after ``event`` (a row of ``EVENT``) and the log of it: (at, seq, outcome)."""
    law, log = settled_by(law, event.at)
    seen = None if pd.isna(event.revision) else Version(event.official, int(event.revision), event.content, event.sections, tuple(() if event.keys is None else event.keys))
    if event.kind == "approve":
        fits = law.candidate is not None and seen is not None and replace(seen, keys=()) == replace(law.candidate, keys=())
        law, outcome = (activated(law), "APPROVED") if fits else (law, "REFUSED")
    elif event.error is not None or seen is None:
        outcome, law = "FAILED", replace(law, status="FAILED")  # what is in force and what waits stay
    else:
        law, outcome = checked(law, seen, (event.approved_content, event.approved_sections), event.at)
    return law, [*log, (event.at, event.seq, outcome)]


def told(law_id: int, made: list[tuple[Law, list[tuple[datetime, int, str]]]]) -> pd.DataFrame:
    rows = [(law_id, at, seq, outcome, law.status, law.active and law.active.revision, law.candidate and law.candidate.revision) for law, log in made for at, seq, outcome in log]
    frame = pd.DataFrame(rows, columns=["law_id", "at", "seq", "outcome", "status", "active_revision", "candidate_revision"])
    return frame.astype({"active_revision": "Int64", "candidate_revision": "Int64"})


def ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    events = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
    return events.astype(object).where(events.notna(), None)


def steps(law: Law, events: pd.DataFrame) -> Iterator[tuple[Law, list[tuple[datetime, int, str]]]]:
    """The law after each event, and what each adds to the log; a version that settles in between is a step of its own."""
    for event in events.itertuples():
        settled, log = settled_by(law, event.at)
        if log:
            yield settled, log
        law, log = folded(settled, event)
        yield law, log


def replayed(events: DataFrame, until: datetime | None = None) -> DataFrame:
    """The log of every law of a batch of ``events``: law_id, at, seq, outcome, and the law after it. What settles by ``until`` without a
    further event is added, with a seq of -1. A law's events stand together and in order, and one is folded after another, so a task
    holds one law and one batch however many laws there are and however long they are."""

    def fold(rows: Iterator[Any]) -> Iterator[tuple]:
        told = lambda key, law, log: [(key, at, seq, outcome, law.status, law.active and law.active.revision, law.candidate and law.candidate.revision) for at, seq, outcome in log]
        for key, own in groupby(rows, attrgetter("law_id")):
            law = Law()
            for event in own:
                law, log = settled_by(law, event.at)
                yield from told(key, law, log)
                law, log = folded(law, event)
                yield from told(key, law, log)
            if until is not None:
                law, log = settled_by(law, until)
                yield from told(key, law, log)

    return in_order(events, "law_id", fold, RESULT)


class Monitor(StatefulProcessor):
    """A law's wordings as two values, its log as a list, and a timer on what waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", VERSION)
        self.candidate = handle.getValueState("candidate", f"{VERSION}, unmatched boolean, staged timestamp")
        self.status = handle.getValueState("status", "status string")
        self.log = handle.getListState("log", "at timestamp, seq long, outcome string")

    def read(self) -> Law:
        active = Version(*self.active.get()[:4], tuple(self.active.get()[4])) if self.active.exists() else None
        status = self.status.get()[0] if self.status.exists() else "UNKNOWN"
        if not self.candidate.exists():
            return Law(active, status=status)
        *own, keys, unmatched, staged = self.candidate.get()
        return Law(active, Version(*own, tuple(keys)), unmatched, staged, status)

    def write(self, law: Law, made: list[tuple[Law, list]]) -> None:
        as_row = lambda v: (v.official, v.revision, v.content, v.sections, list(v.keys))
        if law.active is not None:
            self.active.update(as_row(law.active))
        if law.candidate is not None:
            self.candidate.update((*as_row(law.candidate), law.unmatched, law.staged))
        else:
            self.candidate.clear()
        self.status.update((law.status,))
        if lines := [line for _, log in made for line in log]:
            self.log.appendList(lines)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if law.staged is not None and approvable(law):
            self.handle.registerTimer(int((law.staged + SETTLE).timestamp() * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        law = self.read()
        made = [*steps(law, ordered(rows))]
        self.write(made[-1][0] if made else law, made)
        yield told(key[0], made)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        law, log = settled_by(self.read(), datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000))
        self.write(law, [(law, log)])
        yield told(key[0], [(law, log)])

    def close(self) -> None:
        pass


def monitored(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """``replayed`` as a stream: the log as it grows. Events may come ``late``; what settles is logged when event time has passed it.
    The session keeps state in RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    watched = events.withWatermark("at", late)
    return watched.groupBy("law_id").transformWithStateInPandas(Monitor(), RESULT, "Append", "EventTime")
