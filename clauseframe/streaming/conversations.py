"""Conversation state: a keyed state machine over turns, as a fold of a batch or of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States and what each may move to; staying is always allowed.
MOVES = {"PRIORITIZE": ("STRATEGY",), "STRATEGY": ("DRAFT",), "DRAFT": ("STRATEGY", "COUNTER"), "COUNTER": ("DONE",), "DONE": ()}
MOST_TURNS = 60
STATE = "state string, user_turns int, last_turn long"
RESULT = "conv_id long, state string, user_turns int, last_turn long"


def summary(turns: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """Each turn with how many user turns there were up to it, and whether the conversation ends with it or is over its limit."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    users = F.sum((F.col("role") == "user").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead("turn").over(order).isNull()
    return turns.withColumn("user_turns", users).withColumn("terminal", last & (F.col("role") == "assistant")).withColumn("over_limit", users > most)


def step(state: str, asked: str | None) -> str:
    """The state after a move is asked for; a move that is not allowed changes nothing."""
    return asked if asked in MOVES.get(state, ()) else state


def fold(rows: Iterator[tuple[int, str, str | None]], state: tuple[str, int, int], most: int = MOST_TURNS) -> tuple[str, int, int]:
    """(turn, role, asked) in order onto (state, user turns, last turn). Done conversations and repeated turns change nothing."""
    now, users, last = state
    for turn, role, asked in rows:
        if turn <= last or now == "DONE":
            continue
        last = turn
        if role == "user":
            if users >= most:
                continue
            users += 1
        now = step(now, asked)
    return now, users, last


#: How long the state of a conversation in which nothing happens is kept.
KEPT_MS = 30 * 24 * 3600 * 1000


def stream_states(turns: DataFrame, kept_ms: int = KEPT_MS) -> DataFrame:
    """(conv_id, state, user_turns, last_turn) as they change, from a streaming frame (conv_id, turn, role, asked).

    A conversation's state goes ``kept_ms`` after its last turn arrived, so state is bounded by what happens in that time.
    Spark runs empty batches to see to such timeouts; a replay (``availableNow``) therefore ends only in a session that sets
    spark.sql.streaming.noDataMicroBatches.enabled to false.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else ("PRIORITIZE", 0, -1)
        rows = pd.concat(list(frames)).sort_values("turn")
        now = fold(zip(rows.turn.tolist(), rows.role.tolist(), [None if pd.isna(a) else a for a in rows.asked], strict=True), now)
        state.update(now)
        state.setTimeoutDuration(kept_ms)
        yield pd.DataFrame([(key[0], *now)], columns=["conv_id", "state", "user_turns", "last_turn"])

    return turns.groupBy("conv_id").applyInPandasWithState(run, RESULT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
