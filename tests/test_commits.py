"""Atomic commits: one of two writers is refused, and readers see whole versions only."""

import threading

import pytest
from pyspark.sql import functions as F

from clauseframe.operators import repository as P
from clauseframe.sources import commits


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_are_read_as_committed(spark, tmp_path):
    where = f"file://{tmp_path}/t"
    assert commits.current(spark, where) == 0
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id int, `odd name` string")
    assert commits.commit(first, where, 0) == 1
    changed = P.upsert(commits.read(spark, where), spark.createDataFrame([(2, "B"), (3, "c")], first.schema), "id")
    assert commits.commit(changed, where, 1) == 2
    assert rows(commits.read(spark, where)) == [(1, "a"), (2, "B"), (3, "c")] and rows(commits.read(spark, where, 1)) == [(1, "a"), (2, "b")]
    with pytest.raises(commits.Refused):
        commits.commit(first, where, 1)
    assert commits.current(spark, where) == 2
    assert commits.commit(first.limit(0), where, 2) == 3 and rows(commits.read(spark, where)) == []


def test_of_many_writers_one_is_accepted(spark, tmp_path):
    where = f"file://{tmp_path}/t"
    commits.commit(spark.range(3).withColumn("by", F.lit(-1)), where, 0)
    done, refused = [], []

    def write(n):
        try:
            done.append((n, commits.commit(spark.range(100).withColumn("by", F.lit(n)), where, 1)))
        except commits.Refused:
            refused.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and len(refused) == 5 and done[0][1] == 2
    assert rows(commits.read(spark, where)) == [(i, done[0][0]) for i in range(100)]
    assert rows(commits.read(spark, where, 1)) == [(i, -1) for i in range(3)]


def test_a_writer_that_dies_leaves_nothing_to_read(spark, tmp_path):
    where = f"file://{tmp_path}/t"
    commits.commit(spark.range(2), where, 0)
    with pytest.raises(Exception, match="not today"):
        commits.commit(spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("not today"))).otherwise(F.col("id").cast("string")).alias("id")), where, 1)
    assert commits.current(spark, where) == 1 and rows(commits.read(spark, where)) == [(0,), (1,)]
