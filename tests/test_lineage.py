"""Lineage by pointer doubling, and event streams decoded piece by piece."""

import random

from clauseframe.operators.lineage import lineage
from clauseframe.sources import feeds
from clauseframe.streaming import replies


def plain(parents):
    out = {}
    for k in parents:
        seen, at = [k], k
        while parents[at] in parents and parents[at] not in seen:
            at = parents[at]
            seen.append(at)
        loop = parents[at] in seen
        out[k] = (None, None) if loop else (at, len(seen))
    return out


def test_lineage_of_chains_trees_and_loops(spark):
    rng = random.Random(2)
    parents = {i: i - 1 if i % 1000 else None for i in range(2000)}  # chains of 1,000 versions
    parents |= {5000 + i: 5000 if i else None for i in range(300)}  # one root of many
    parents |= {7000 + i: 7000 + rng.randrange(i) if i else 9_999_999 for i in range(200)}  # a tree under a parent that is no row
    parents |= {8000: 8002, 8001: 8000, 8002: 8001, 8003: 8000, 8004: 8004}  # loops, and a row that leads to one
    rows = [*parents.items(), (0, None), (1, 0), (None, 3)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "id long, parent long").selectExpr("*", "'x' AS up", "1 AS steps")
    got = {r.id: (r.root, r.version) for r in lineage(frame, "id", "parent").collect()}
    assert got == plain(parents)
    assert lineage(frame.limit(0), "id", "parent").collect() == []


def made_stream(rng):
    text = ""
    for _ in range(rng.randrange(6)):
        end = rng.choice(("\n", "\r\n", "\r"))
        text += end.join(rng.choice(("data: x", "data:{\"a\": 1}", "event: y", "data:", ": note")) for _ in range(rng.randrange(4))) + end * rng.randrange(1, 4)
    return text + rng.choice(("", "data: open", "\r", "\n"))


def cut(rng, text):
    places = sorted(rng.choices(range(len(text) + 1), k=rng.randrange(6)))
    return [text[a:b] for a, b in zip([0, *places], [*places, len(text)], strict=True)]


def test_any_cut_gives_the_same_blocks(spark):
    rng = random.Random(3)
    texts = [made_stream(rng) for _ in range(300)]
    whole = {}
    for r in feeds.event_blocks(spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "k int, o int, text string"), "k", "o").where("complete").collect():
        whole.setdefault(r.k, []).append((r.ord, r.data))
    for i, text in enumerate(texts):
        for _ in range(6):
            carry, got = replies.START, []
            for piece in cut(rng, text):
                carry, blocks = replies.decode(carry, piece)
                got += blocks
            # a carriage return at the very end is a line's end only once the stream is over
            if not text.endswith("\r"):
                assert got == sorted(whole.get(i, [])), text


def test_blocks_of_a_running_stream(spark, tmp_path):
    rng = random.Random(5)
    texts = {i: made_stream(rng) + "data: last\n\n" for i in range(20)}
    batches = [[], [], []]
    for i, text in texts.items():
        places = cut(rng, text)
        for n, piece in enumerate(places):
            batches[min(2, 3 * n // len(places))].append((i, n, piece))
    schema, source = "stream_id long, at long, text string", tmp_path / "pieces"
    source.mkdir()
    stream = replies.decoded(spark.readStream.schema(schema).parquet(str(source)))
    old = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", old)
    got = sorted((r.stream_id, r.ord, r.data) for r in spark.read.schema(replies.RESULT).parquet(str(tmp_path / "out")).collect())
    want = []
    for i, text in texts.items():
        want += [(i, *b) for b in replies.decode(replies.START, text)[1]]
    assert got == sorted(want)
