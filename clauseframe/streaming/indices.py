"""The price index as its readers get it: a value that was fetched is kept for a day, a failure for an hour, and then the last good value or an assumption serves.

``called`` is one step and is shared: ``served`` folds a table of calls, ``serving`` a stream of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.feeds import FALLBACK_PERCENT

HOUR = 3600 * 10**6
KEPT, KEPT_AFTER_FAILURE = 24 * HOUR, HOUR
#: How long a stream remembers the last good value of a key that nobody asks for.
FORGOTTEN_MS = 90 * 24 * 3600 * 1000


class Kept(NamedTuple):
    """``expires`` in microseconds; ``good`` is the last value that was fetched."""

    expires: int = -(2**62)
    percent: float = FALLBACK_PERCENT
    source: str = "ASSUMPTION"
    good: float | None = None


RESULT = {"fetched": "boolean", "source": "string", "percent": "double"}


def called(kept: Kept, at: int, offered: float | None) -> tuple[Kept, tuple[bool, str, float]]:
    """A call at ``at``; ``offered`` is what a fetch would bring now, or None if it would fail. It is looked at only if nothing that is kept holds."""
    if kept.expires > at:
        return kept, (False, kept.source, kept.percent)
    if offered is not None:
        kept = Kept(at + KEPT, offered, "FETCHED", offered)
    elif kept.good is not None:
        kept = Kept(at + KEPT_AFTER_FAILURE, kept.good, "LAST_GOOD", kept.good)
    else:
        kept = Kept(at + KEPT_AFTER_FAILURE)
    return kept, (True, kept.source, kept.percent)


def slim(calls: DataFrame) -> DataFrame:
    return calls.select("key", "seq", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.nanvl(F.col("percent").cast("double"), F.lit(None)).alias("percent"))


def served(calls: DataFrame) -> DataFrame:
    """(key, seq, fetched, source, percent) of every call of a table (key, at timestamp, seq long, percent double), in the order of at and seq.

    A key's calls follow each other, but they are read as a sorted stream with one small state, so no task holds them together.
    A null key is a key of its own; a null or NaN percent is a failure.
    """
    rows = slim(calls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = object(), Kept()
        for batch in batches:
            out = []
            for key, at, percent in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "percent")), strict=True):
                if key != now:
                    now, kept = key, Kept()
                kept, told = called(kept, at, percent)
                out.append(told)
            made = [pa.array([t[i] for t in out], k) for i, k in enumerate((pa.bool_(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seq"), *made], ["key", "seq", *RESULT])

    told = ", ".join([f"key {rows.schema['key'].dataType.simpleString()}", f"seq {rows.schema['seq'].dataType.simpleString()}", *(f"{n} {k}" for n, k in RESULT.items())])
    return rows.repartition("key").sortWithinPartitions("key", "at", "seq").mapInArrow(run, told)


def serving(calls: DataFrame) -> DataFrame:
    """``served`` of a streaming frame with keys of type long. Calls are answered in the order of at inside a micro-batch; state is four fields a key and
    goes when nobody has asked for ``FORGOTTEN_MS``. A replay (``availableNow``) ends only in a session that sets
    spark.sql.streaming.noDataMicroBatches.enabled to false, as Spark runs empty batches to see to such timeouts."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, out = Kept(*state.get) if state.exists else Kept(), []
        for row in pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable").itertuples():
            kept, told = called(kept, row.at, None if pd.isna(row.percent) else row.percent)
            out.append((key[0], row.seq, *told))
        state.update(tuple(kept))
        state.setTimeoutDuration(FORGOTTEN_MS)
        yield pd.DataFrame(out, columns=["key", "seq", *RESULT])

    told = ", ".join(["key long", "seq long", *(f"{n} {k}" for n, k in RESULT.items())])
    return slim(calls).groupBy("key").applyInPandasWithState(run, told, "expires long, percent double, source string, good double", "append", GroupStateTimeout.ProcessingTimeTimeout)
