"""The log of JSON lines as a data source: ranges, commits, streams."""

import json

import pytest
from pyspark.sql import functions as F

from clauseframe.sources import feeds
from clauseframe.sources.linelog import Folder, LineLog, end


@pytest.fixture
def log(spark, tmp_path):
    spark.dataSource.register(LineLog)
    return str(tmp_path / "log")


def read(spark, log, **options):
    return spark.read.format("line_log").options(path=log, **options).load()


def write(df, log):
    df.write.format("line_log").option("path", log).mode("append").save()


def test_a_batch_ends_with_its_result_in_any_ranges(spark, log):
    assert read(spark, log).count() == 0
    events = spark.range(0, 500, 1, 7).select(F.to_json(F.struct("id", F.concat(F.lit("שלב "), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).alias("says"))).alias("value"), F.lit(1).alias("other"))
    write(events.unionByName(spark.createDataFrame([(None, 1)], "value string, other int")), log)
    want = sorted(r.value for r in events.collect())
    for size in (97, 1000, 10**9):
        rows = read(spark, log, range_bytes=size).orderBy("entry", "part", "at").collect()
        assert sorted(r.value for r in rows[:-1]) == want and json.loads(rows[-1].value) == {"type": "result", "lines": 500}
        assert len({(r.part, r.at) for r in rows}) == 501
    assert read(spark, log, range_bytes=1000).rdd.getNumPartitions() > 20


def test_a_failed_write_leaves_one_error_and_no_lines(spark, log):
    write(spark.createDataFrame([('{"n":1}',)], "value string"), log)
    bad = spark.range(0, 8, 1, 4).select(F.when(F.col("id") == 5, "a\nb").otherwise(F.to_json(F.struct("id"))).alias("value"))
    with pytest.raises(Exception, match="line break"):
        write(bad, log)
    rows = read(spark, log).orderBy("entry", "part", "at").collect()
    assert [json.loads(r.value).get("type", "line") for r in rows] == ["line", "result", "error"]
    with pytest.raises(Exception, match="value"):
        write(spark.range(3), log)


def test_two_writers_get_two_entries(log):
    a, b = Folder(log), Folder(log)
    assert a.add(0, [], {"type": "result"}) and not b.add(0, [], {"type": "error"}) and b.append([], {"type": "error"}) == 1
    assert a.entry(0)["end"] == {"type": "result"} and a.count() == 2
    for n in range(2, 40):
        assert a.count() == n and a.append([], None) == n


def test_a_stream_in_and_out_of_logs(spark, log, tmp_path):
    out, where = str(tmp_path / "out"), str(tmp_path / "state")
    body = lambda y: json.dumps({"month": [{"date": [{"year": y, "month": 1, "percent": 0.1, "percentYear": y / 1000}]}]})

    def run():
        months = feeds.index_months(spark.readStream.format("line_log").option("path", log).load(), "value")
        q = feeds.progress_lines(months, "period", "percent_year").writeStream.format("line_log").option("path", out).option("checkpointLocation", where).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive and q.exception() is None

    def told():
        return [json.loads(r.value) for r in read(spark, out).orderBy("entry", "part", "at").collect()]

    write(spark.createDataFrame([(body(2023),)], "value string"), log)
    run()
    assert told() == [{"period": "2023-01", "percent_year": 2.023}]
    write(spark.createDataFrame([(body(2024),)], "value string"), log)
    write(spark.createDataFrame([(body(2025),)], "value string"), log)
    run()
    assert [x["period"] for x in told()] == ["2023-01", "2024-01", "2025-01"]
    before = Folder(out).count()
    assert not Folder(out).add(before - 1, [], None)  # a batch that comes again finds its entry
    with pytest.raises(ValueError, match="result or an error"):
        end(out, {"type": "other"})
    assert end(out, {"type": "result", "months": 3}) == before and told()[-1] == {"type": "result", "months": 3}
