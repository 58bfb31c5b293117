"""The index as its readers get it, names and lineage of uploads."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from clauseframe.sources import feeds
from clauseframe.streaming import indices

CALLS = "key long, at timestamp, seq long, percent double"
START = datetime(2025, 1, 1)


def test_a_table_and_a_stream_serve_the_same(spark, tmp_path):
    told = [(1, 0, None), (1, 0.5, 3.0), (1, 1, 3.0), (1, 24.9, 4.0), (1, 25, None), (1, 25.9, 5.0), (1, 26, 5.0), (None, 0, 1.0), (None, 1, 2.0), (2, 0, float("nan")), (2, 2, 7.0)]
    rows = [(k, START + timedelta(hours=h), i, p) for i, (k, h, p) in enumerate(told)]
    got = {r.seq: (r.fetched, r.source, r.percent) for r in indices.served(spark.createDataFrame(rows[::-1], CALLS)).collect()}
    want = [(True, "ASSUMPTION", 2.5), (False, "ASSUMPTION", 2.5), (True, "FETCHED", 3.0), (False, "FETCHED", 3.0), (True, "LAST_GOOD", 3.0), (False, "LAST_GOOD", 3.0), (True, "FETCHED", 5.0)]
    assert [got[i] for i in range(7)] == want and got[7] == (True, "FETCHED", 1.0) and got[8] == (False, "FETCHED", 1.0) and got[9] == (True, "ASSUMPTION", 2.5) and got[10] == (True, "FETCHED", 7.0)
    assert indices.served(spark.createDataFrame([], CALLS)).count() == 0

    where = str(tmp_path / "in")
    seen = {}
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a replay waits for timeouts and never ends
    for part in (rows[:4], rows[4:]):  # the state has to outlive a stop
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(where)
        calls = spark.readStream.schema(CALLS).parquet(where)
        q = indices.serving(calls).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        seen[r.seq] = (r.fetched, r.source, r.percent)
    assert seen == got


def test_uploads(spark):
    names = spark.createDataFrame([("a/b/c.pdf", "c.pdf"), ("c\x00\x1f\x7f.pdf", "c.pdf"), ("a/b//", "b"), ("", "")], "path string, want string")
    assert all(r.got == r.want for r in names.select(feeds.file_name(F.col("path")).alias("got"), "want").collect())
    known = spark.createDataFrame([("1", 7), ("2", 8)], "contract_id string, user_id int")
    uploads = spark.createDataFrame([("3", 7, None), ("4", 7, "  "), ("5", 7, " 1 "), ("6", 7, "2"), ("7", 7, "9"), ("8", None, "1")], "contract_id string, user_id int, previous_contract_id string")
    got = {r.contract_id: r.lineage for r in feeds.continued(uploads, known).collect()}
    assert got == {"3": "NEW", "4": "NEW", "5": "CONTINUES", "6": "PREVIOUS_NOT_FOUND", "7": "PREVIOUS_NOT_FOUND", "8": "PREVIOUS_NOT_FOUND"}
