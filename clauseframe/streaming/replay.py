"""A batch of events folded in order, key by key, as a stream of rows instead of a frame for each key."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a result may be made of.
KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "timestamp": pa.timestamp("us", "UTC")}
#: Rows of a batch that goes back.
ROWS = 10_000


def in_order(events: DataFrame, key: str, fold: Callable[[Iterator[Any]], Iterator[tuple]], result: str) -> DataFrame:
    """What ``fold`` makes of the rows of ``events``: those of a key follow each other, by ``at`` and ``seq``. Times are local to the session,
    without a zone. A task holds a batch at a time, and small keys cost no more than their rows."""
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    schema = pa.schema([(f.name, KINDS[f.dataType.simpleString()]) for f in StructType.fromDDL(result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Any]:
            for b in batches:
                event = namedtuple("Event", b.schema.names)
                local = [pc.local_timestamp(c) if pa.types.is_timestamp(c.type) and c.type.tz else c for c in b.columns]
                yield from map(event._make, zip(*(c.to_pylist() for c in local), strict=True))

        made = fold(rows())
        while part := list(islice(made, ROWS)):
            columns = []
            for kind, values in zip(schema.types, zip(*part, strict=True), strict=True):
                column = pa.array(values, pa.timestamp("us") if pa.types.is_timestamp(kind) else kind)
                columns.append(pc.assume_timezone(column, zone, ambiguous="latest", nonexistent="latest").cast(kind) if pa.types.is_timestamp(kind) else column)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    order = [F.col(c).asc_nulls_last() for c in ("at", "seq")]
    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, result)
