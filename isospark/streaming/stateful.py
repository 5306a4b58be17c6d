"""Sessions over streams: typed state, event-time timers, and a buffer for rows that arrive out of order.

A row waits in its session's buffer until the watermark has passed its time, so
all rows before it have arrived; then the session's step runs over the waiting
rows in order and gives one row for each. So a stream gives the rows of the batch
operators, however its rows are dealt to micro-batches. Rows behind the watermark
are dropped, as Spark does with late rows. The state store must be able to keep
several values by key (RocksDB): set PROVIDER before the stream starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, TimestampType

from .. import params as P
from .session import lod_row, zoom_step

#: Setting and value that these streams need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def clock_step(state: tuple, toggle: bool, delta: float) -> tuple:
    """(playing, time) after a frame; a toggle acts before the frame's own delta."""
    playing, time = state[0] != bool(toggle), state[1]
    return playing, (time + min(delta, P.MAX_DELTA)) % P.LOOP_SECONDS if playing else time


def scrub_step(state: tuple, action: str, pointer: int, position: float, delta: float) -> tuple:
    """(playing, scrubbing, time, pointer that holds the timeline) after an event; actions as in session.scrub."""
    playing, scrubbing, time, holder = state
    if action == "down":
        return False, True, position, pointer
    if action == "input" or (action == "move" and pointer == holder):
        time = position
    elif action in ("up", "cancel") and pointer == holder:
        scrubbing, holder = False, None
    elif action == "toggle":
        playing = not playing
    elif action == "tick" and playing and not scrubbing:
        time = (time + min(delta, P.MAX_DELTA)) % P.LOOP_SECONDS
    return playing, scrubbing, time, holder


#: What runs over a session: step, its inputs, the state it begins with, the state's columns.
KINDS = {
    "clock": (clock_step, ("toggle", "delta"), (True, 0.0), "playing boolean, time double"),
    "scrub": (scrub_step, ("action", "pointer", "position", "delta"), (True, False, 0.0, None), "playing boolean, scrubbing boolean, time double, holder long"),
    "zoom": (zoom_step, ("action", "amount", "touches"), (1.0, 1.0, 0.0), "zoom double, start_zoom double, start_distance double"),
    "levels": (lod_row, ("delta", "desired"), (None,) * 5, "level int, coarse int, fine int, progress double, direction int"),
}


def _plain(value):
    """A cell as pandas gives it, with None for missing."""
    return None if value is None or value is pd.NaT or value != value else value


class OrderedSession(StatefulProcessor):
    """Buffers a session's rows by time and steps over those that the watermark has passed."""

    def __init__(self, step: Callable, start: tuple, inputs: tuple[str, ...], row: StructType, state: str, out: list[str]):
        self.step, self.start, self.inputs, self.row, self.kept, self.out = step, start, inputs, row, state, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.kept)
        self.waiting = handle.getListState("waiting", self.row)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for pdf in rows:
            batch = [tuple(map(_plain, r)) for r in pdf[self.row.names].itertuples(index=False)]
            self.waiting.appendList(batch)
            due |= {self._due(r[0]) for r in batch}
        known = set(self.handle.listTimers())
        for at in due - known:
            self.handle.registerTimer(at)
        yield pd.DataFrame(columns=self.out)

    @staticmethod
    def _due(at: pd.Timestamp) -> int:
        """The first whole millisecond at or after a row's time."""
        return -(-pd.Timestamp(at).value // 1_000_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get())
        ready = sorted((r for r in rows if self._due(r[0]) <= passed), key=lambda r: (r[0], r[1]))
        if not ready:
            yield pd.DataFrame(columns=self.out)
            return
        rest = [r for r in rows if self._due(r[0]) > passed]
        self.waiting.clear()
        if rest:
            self.waiting.appendList(rest)
        state = tuple(self.state.get()) if self.state.exists() else self.start
        made = []
        for r in ready:
            state = self.step(tuple(state), *r[2:])
            made.append((key[0], r[1], *state))
        self.state.update(tuple(state))
        yield pd.DataFrame(made, columns=self.out).astype(object).where(lambda d: d.notna(), None)


def session_stream(events: DataFrame, kind: str, session: str = "session", at: str = "ts", seq: str = "seq", lateness: str = "10 seconds") -> DataFrame:
    """session, seq and the state after each event of a stream (session, at, seq and the inputs of the kind).

    kind: clock, scrub, zoom or levels (KINDS). Events are in order of at, then
    seq; a session's rows may arrive up to lateness behind the latest one of all.
    """
    step, inputs, start, state = KINDS[kind]
    names = [part.split()[0] for part in state.split(", ")]
    row = StructType([StructField("at", TimestampType()), StructField("seq", events.schema[seq].dataType), *(StructField(c, events.schema[c].dataType) for c in inputs)])
    key = events.schema[session].dataType.simpleString()
    given = events.withWatermark(at, lateness).select(events[session].alias("session"), events[at].alias("at"), events[seq].alias("seq"), *inputs)
    processor = OrderedSession(step, start, inputs, row, state, ["session", "seq", *names])
    return given.groupBy("session").transformWithStateInPandas(processor, f"session {key}, seq {events.schema[seq].dataType.simpleString()}, {state}", "Append", "EventTime")
