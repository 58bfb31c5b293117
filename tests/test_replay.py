"""Batches of events folded as one stream of rows: no frame for each key."""

import contextlib
import io
from datetime import datetime

import pytest

import __spark_entry__ as entry
from clauseframe.streaming.replay import in_order

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["law_monitor", "negotiation_calls"])
def test_a_key_is_no_group_of_its_own(spark, name):
    with contextlib.redirect_stdout(io.StringIO()) as told:
        entry.queries()[name](spark, SMALL).explain()
    assert "FlatMapGroups" not in told.getvalue() and "MapInArrow" in told.getvalue()


def test_rows_of_a_key_follow_each_other_by_time(spark):
    rows = [(k, datetime(2024, 1, 1 + (7 * i + k) % 20), i) for k in range(40) for i in range(30)]

    def counted(events):
        last = None
        for e in events:
            n = n + 1 if last is not None and last[0] == e.k else 1
            assert last is None or last[0] != e.k or last[1:] <= (e.at, e.seq)
            last = (e.k, e.at, e.seq)
            yield e.k, e.at, n

    got = in_order(spark.createDataFrame(rows, "k long, at timestamp, seq long"), "k", counted, "k long, at timestamp, n int").collect()
    assert len(got) == len(rows) and {(r.k, r.n) for r in got} == {(k, i) for k in range(40) for i in range(1, 31)}
    assert sorted((r.k, r.at) for r in got) == sorted((k, at) for k, at, _ in rows)
