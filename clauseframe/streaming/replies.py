"""Event streams that arrive in pieces, decoded while they come: what a piece does not end is carried over as keyed state."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: What is carried over: text behind the last blank line, a carriage return that may go on, whether a blank line has just ended, the next
#: block's number, the next piece's.
CARRY = "tail string, pending boolean, after boolean, ord int"
START = ("", False, False, 0)
RESULT = "stream_id long, ord int, data string"
KEPT_MS = 3600 * 1000


def decode(carry: tuple[str, bool, bool, int], piece: str) -> tuple[tuple[str, bool, bool, int], list[tuple[int, str]]]:
    """The carry after ``piece``, and the blocks that it ends: (number, their ``data`` lines joined by line breaks). Blocks are counted from
    0 and end at one or more blank lines; those without data are counted and left out. The cost is linear in the piece and the open block."""
    tail, pending, after, ord_ = carry
    text = ("\r" if pending else "") + piece
    pending = text.endswith("\r")  # a line feed may follow
    text = re.sub(r"\r\n?", "\n", text[:-1] if pending else text)
    if after:
        text = text.lstrip("\n")
    if not text:
        return (tail, pending, after, ord_), []
    *ended, tail = re.split(r"\n{2,}", tail + text)
    out = []
    for block in ended:
        lines = [re.sub(r"^data: ?", "", x) for x in block.split("\n") if x.startswith("data:")]
        if lines:
            out.append((ord_, "\n".join(lines)))
        ord_ += 1
    return (tail, pending, bool(ended) and not tail, ord_), out


def decoded(pieces: DataFrame, kept_ms: int = KEPT_MS) -> DataFrame:
    """(stream_id, ord, data) of each block as soon as it is complete, from a streaming frame (stream_id, at, text). Pieces of a stream
    arrive in the order of ``at``, which is also that inside a micro-batch; a null text is an empty piece. State is one open block a
    stream and goes ``kept_ms`` after its last piece."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        carry, out = (state.get if state.exists else START), []
        for text in pd.concat(list(frames)).sort_values("at", kind="stable").text:
            carry, blocks = decode(carry, "" if pd.isna(text) else text)
            out += blocks
        state.update(carry)
        state.setTimeoutDuration(kept_ms)
        yield pd.DataFrame([(key[0], *b) for b in out], columns=["stream_id", "ord", "data"])

    return pieces.groupBy("stream_id").applyInPandasWithState(run, RESULT, CARRY, "append", GroupStateTimeout.ProcessingTimeTimeout)
