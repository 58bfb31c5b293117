"""The state of monitored laws: a stream's log equals the batch plan's, and both equal the rules applied one by one."""

import random
from datetime import datetime, timedelta

from clauseframe.streaming import laws

START = datetime(2026, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event(law, hours, seq, kind="check", official="o1", revision=1, content="c1", sections="s1", keys=("a", "b"), approved=(None, None), error=None):
    return (law, START + timedelta(hours=hours), seq, kind, official, revision, content, sections, list(keys), *approved, error)


def random_events(rng, law, n):
    out, hour = [], 0
    for seq in range(n):
        hour += rng.choice((1, 5, 30))
        version = rng.randrange(3)
        kind = "approve" if rng.random() < 0.25 else "check"
        approved = rng.choice(((None, None), (f"c{version}", "s")))
        out.append(event(law, hour, seq, kind, f"o{rng.randrange(2)}", version, f"c{version if rng.random() < 0.7 else 0}", "s", rng.choice((("a", "b"), ("a",), ())), approved, "down" if rng.random() < 0.1 else None))
    return out


def plain(events, until):
    """Outcomes by the rules, in words of their own: dictionaries, no classes."""
    active = waiting = None
    out = []

    def settle(now):
        nonlocal active, waiting
        if waiting and active and not waiting["odd"] and active["keys"] and waiting["at"] + timedelta(hours=24) <= now and len(active["keys"] & waiting["keys"]) / len(active["keys"]) >= 0.9:
            out.append((waiting["at"] + timedelta(hours=24), -1, "AUTO_APPROVED"))
            active, waiting = waiting, None

    for _, at, seq, kind, official, revision, content, sections, keys, ac, as_, error in sorted(events, key=lambda e: (e[1], e[2])):
        settle(at)
        own = {"o": official, "r": revision, "c": content, "s": sections, "keys": set(keys), "at": at, "odd": False}
        if kind == "approve":
            good = waiting and all(waiting[k] == own[k] for k in "orcs")
            if good:
                active, waiting = waiting, None
            out.append((at, seq, "APPROVED" if good else "REFUSED"))
        elif error:
            out.append((at, seq, "FAILED"))
        elif active and active["o"] == official and (active["c"], active["s"]) == (content, sections):
            active, waiting = active | {"keys": set(keys)}, None
            out.append((at, seq, "UNCHANGED"))
        elif waiting and all(waiting[k] == own[k] for k in "orc"):
            out.append((at, seq, "UNCHANGED"))
        elif active and active["o"] != official and active["c"] == content or active and active["o"] == official and active["r"] == revision and active["c"] == content:
            waiting = None
            out.append((at, seq, "OFFICIAL_UPDATE_PENDING"))
        else:
            own["odd"] = bool(active and active["o"] == official and active["r"] != revision and (ac, as_) != (content, sections))
            waiting = own
            out.append((at, seq, "STAGED_UNMATCHED" if own["odd"] else "STAGED"))
    settle(until)
    return out


def test_each_decision(spark):
    rows = [
        event(1, 0, 0), event(1, 1, 1, "approve"), event(1, 2, 2), event(1, 3, 3, official="o2"), event(1, 4, 4, revision=2, content="c2"), event(1, 5, 5, revision=2, content="c2"),
        event(1, 6, 6, error="timeout"), event(1, 7, 7, "approve", revision=3), event(1, 8, 8, revision=3, content="c3", approved=("c3", "s1")), event(1, 60, 9, revision=3, content="c3"),
    ]
    got = [(r.seq, r.outcome, r.status, r.active_revision, r.candidate_revision) for r in laws.replayed(spark.createDataFrame(rows, laws.EVENT)).orderBy("at", "seq").collect()]
    assert got == [
        (0, "STAGED", "AWAITING_APPROVAL", None, 1), (1, "APPROVED", "ACTIVE", 1, None), (2, "UNCHANGED", "ACTIVE", 1, None), (3, "OFFICIAL_UPDATE_PENDING", "OFFICIAL_UPDATE_PENDING", 1, None),
        (4, "STAGED_UNMATCHED", "TEXT_CHANGED", 1, 2), (5, "UNCHANGED", "TEXT_CHANGED", 1, 2), (6, "FAILED", "FAILED", 1, 2), (7, "REFUSED", "FAILED", 1, 2),
        (8, "STAGED", "AWAITING_APPROVAL", 1, 3), (-1, "AUTO_APPROVED", "ACTIVE", 3, None), (9, "UNCHANGED", "ACTIVE", 3, None),
    ]


def test_a_replayed_stream_equals_the_batch_and_the_rules(spark, tmp_path):
    rng = random.Random(4)
    events = [e for law in range(12) for e in random_events(rng, law, rng.randrange(1, 14))]
    last = max(e[1] for e in events)
    until = last + timedelta(days=40)
    batch = laws.replayed(spark.createDataFrame(events, laws.EVENT), until)
    rows = lambda frame: sorted((r.law_id, r.at, r.seq, r.outcome, r.status, r.active_revision, r.candidate_revision) for r in frame.collect())
    want = rows(batch)
    assert [w[:4] for w in want] == sorted((law, *step) for law in range(12) for step in plain([e for e in events if e[0] == law], until))
    # a law of its own moves the clock on, past all that settles
    events.sort(key=lambda e: (e[1], e[2]))
    ticks = [event(99, (until - START).total_seconds() / 3600 + 2, 0), event(99, (until - START).total_seconds() / 3600 + 4, 1)]
    third = len(events) // 3
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        source = str(tmp_path / "events")
        (tmp_path / "events").mkdir()
        stream = laws.monitored(spark.readStream.schema(laws.EVENT).parquet(source))
        for part in (events[:third], events[third : 2 * third], events[2 * third :], ticks[:1], ticks[1:]):
            spark.createDataFrame(part, laws.EVENT).coalesce(1).write.mode("append").parquet(source)
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [r for r in rows(spark.read.schema(laws.RESULT).parquet(str(tmp_path / "out"))) if r[0] != 99]
    assert got == want


def test_the_query_follows_the_rules(spark, sf):
    from clauseframe.queries import QUERIES
    from clauseframe.queries.laws import law_events

    own = {}
    for r in law_events(spark, sf).collect():
        own.setdefault(r.law_id, []).append(tuple(r))
    got = {}
    for r in QUERIES["law_monitor"](spark, sf).collect():
        got.setdefault(r.law_id, []).append((r.at, r.seq, r.outcome))
    assert got.keys() == own.keys()
    assert all(sorted(got[k]) == sorted(plain(e, datetime(1900, 1, 1))) for k, e in own.items())
    assert {"STAGED", "APPROVED", "REFUSED", "UNCHANGED", "FAILED", "AUTO_APPROVED", "STAGED_UNMATCHED"} <= {o for rows in got.values() for *_, o in rows}
