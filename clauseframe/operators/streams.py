"""Groups of rows worked on in order, as one sorted stream of rows instead of a frame for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are Python objects at once, on the way in and on the way out.
ROWS = 1_000
#: Bytes of a batch that are Python objects at once, unless a row alone has more.
BYTES = 2**20


#: Short texts whose readings a task remembers, and how long they are at most.
REMEMBERED, SHORT = 5_000, 2_000


def remembered(f: Callable[[str], object]) -> Callable[[str], object]:
    """``f`` of a text, computed once in a task for a short text that comes again soon. What it gives is not to be changed."""
    known = lru_cache(REMEMBERED)(f)

    @wraps(f)
    def one(text: str) -> object:
        return known(text) if len(text) <= SHORT else f(text)

    return one


def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``BYTES``, or of one row, as Spark's batches may hold thousands of long texts."""
    for b in batches:
        left = [b]
        while left:
            part = left.pop()
            if part.num_rows > 1 and part.nbytes > BYTES:
                half = part.num_rows // 2
                left += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def in_groups(df: DataFrame, keys: list[str], order: list[str], each: Callable[[tuple, list[tuple]], Iterable[tuple]], result: str) -> DataFrame:
    """What ``each`` makes of every group: it is given the values of ``keys`` and the group's rows, without them, as the other columns of
    ``df`` stand, in ``order`` with nulls last. Groups are spread by their keys; a task holds one group and a few rows, so small groups cost
    no more than their rows."""
    schema = to_arrow_schema(StructType.fromDDL(result))
    slim, n = df.select(*keys, *(c for c in df.columns if c not in keys)), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, ROWS).columns), strict=True)

        made = (out for key, group in groupby(rows(), lambda r: r[:n]) for out in each(key, [r[n:] for r in group]))
        while part := list(islice(made, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema.names)

    return slim.repartition(*keys).sortWithinPartitions(*keys, *(F.col(c).asc_nulls_last() for c in order)).mapInArrow(run, result)
