"""Groups of rows as one sorted stream."""

import contextlib
import io

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from clauseframe.operators import streams
from clauseframe.operators.streams import in_groups
from clauseframe.plans import segment
from clauseframe.sources import pages

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["agreement_alignment", "lis_moved", "agreement_diffs", "clause_alignment", "assignment_optimal", "word_diff"])
def test_a_pair_of_versions_is_no_frame_of_its_own(spark, name):
    with contextlib.redirect_stdout(io.StringIO()) as told:
        entry.queries()[name](spark, SMALL).explain()
    assert "MapInArrow" in told.getvalue() and "FlatMap" not in told.getvalue()


def test_groups_come_whole_and_in_order(spark):
    rows = [(k, n, f"{k}:{n}") for k in (*range(7), None) for n in (*range(1500), None)]
    frame = spark.createDataFrame(rows, "k long, n int, t string").repartition(5)

    def each(key, group):
        places = [n for n, _ in group]
        assert places == [*range(1500), None] and all(t == f"{key[0]}:{n}" for n, t in group)
        yield key[0], len(group)

    assert {tuple(r) for r in in_groups(frame, ["k"], ["n"], each, "k long, many int").collect()} == {(k, 1501) for k in (*range(7), None)}
    assert in_groups(frame.where("false"), ["k"], ["n"], each, "k long, many int").count() == 0


def test_batches_of_long_texts_come_in_pieces():
    texts = ["x" * n for n in (3 * streams.BYTES, 0, 5, *[streams.BYTES // 3] * 10)] + [None]
    parts = [*streams.small([pa.record_batch({"n": [*range(len(texts))], "t": texts}), pa.record_batch({"n": [9], "t": ["y"]})])]
    assert [n for p in parts for n in p.column("n").to_pylist()] == [*range(len(texts)), 9] and [t for p in parts for t in p.column("t").to_pylist()] == [*texts, "y"]
    assert all(p.num_rows == 1 or p.nbytes <= streams.BYTES for p in parts)


class Taken:
    """A frame (k, t) that keeps what is to run over its batches."""

    def __init__(self, spark):
        self.schema = spark.createDataFrame([], "k long, t string").schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, *_):
        self.run = run
        return self


@pytest.mark.parametrize("made", [lambda df: segment.pack_chunks(df, "k", "t"), lambda df: pages.sections(df, "k", "t")])
def test_a_task_turns_few_long_texts_at_once_into_objects(spark, monkeypatch, made):
    frame = Taken(spark)
    monkeypatch.setattr(segment.F, "posexplode", lambda _: frame)
    frame.alias = frame.where = frame.withColumn = lambda *_: frame
    made(frame)
    batch = pa.record_batch({"k": [*range(8)], "t": ["<p>word</p> " * (streams.BYTES // 20)] * 8})
    assert len([*frame.run([batch])]) == 8
