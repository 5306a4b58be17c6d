"""Zoom of sessions as a prefix scan of maps that are closed under composition.

What an event does to a session's state (zoom, zoom at the pinch's start) is a
pair of maps x -> min(max(k x, low), high), each of one of both values: steps and
wheels scale the zoom and clamp it, a reset makes it constant, the start of a
pinch copies the zoom to its start, a move of a pinch scales that start. One
after the other they are such a pair again. So events are dealt into blocks by
their place in order, whatever session they belong to; each block is scanned by
doubling, the last session of a block hands its map on, and the maps of the blocks
that one session spans are scanned once more. A session with a third of all events
is worked on by as many tasks as it has blocks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..lineage import written

#: Events of a block, about.
BLOCK = 250_000
#: Pinches in a row whose values are those of a step by step walk to the last bit; later ones may differ there.
SETTLED = 8
#: A bound that no zoom reaches.
FREE = 1e300
STATE = "zoom double, start_zoom double, start_distance double"


class Maps(NamedTuple):
    """Pairs of maps, for the zoom (row 0) and the zoom at the pinch's start (row 1); source tells which value they take."""

    source: np.ndarray
    k: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def take(self, which) -> Maps:
        return Maps(*(a[:, which] for a in self))

    def put(self, which, other: Maps) -> None:
        for mine, new in zip(self, other, strict=True):
            mine[:, which] = new

    def of(self, zoom: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Both values, from those before."""
        return np.minimum(np.maximum(self.k * np.where(self.source == 0, zoom, start), self.low), self.high)


def nothing(n: int) -> Maps:
    """Maps that leave both values as they are."""
    return Maps(np.repeat([[0], [1]], n, axis=1), np.ones((2, n)), np.zeros((2, n)), np.full((2, n), FREE))


def after(first: Maps, then: Maps) -> Maps:
    """What both do in turn."""
    source, k, low, high = (np.take_along_axis(a, then.source, axis=0) for a in first)
    with np.errstate(over="ignore"):
        low, high = (np.minimum(np.maximum(then.k * x, then.low), then.high) for x in (low, high))
        # A constant needs no factor, which could grow without bound.
        return Maps(source, np.where(low == high, 0.0, k * then.k), low, high)


def prefixes(maps: Maps, starts: np.ndarray) -> Maps:
    """Each map after all before it, from the place `starts` on, by doubling."""
    maps = Maps(*(a.copy() for a in maps))
    place = np.arange(len(starts))
    step, longest = 1, int((place - starts).max(initial=0))
    while step <= longest:
        here = np.flatnonzero(place - step >= starts)
        maps.put(here, after(maps.take(here - step), maps.take(here)))
        step *= 2
    return maps


class Pinches(NamedTuple):
    """The fingers' distance before and after each event, which events begin a pinch, which move one, and which leave the zoom as it is."""

    before: np.ndarray
    distance: np.ndarray
    begins: np.ndarray
    moves: np.ndarray
    keeps: np.ndarray


def of_events(action: np.ndarray, amount: np.ndarray, touches: np.ndarray, starts: np.ndarray, apart: float) -> tuple[Maps, Pinches]:
    """Maps of ordered events, and their pinches; apart is the fingers' distance before the first one."""
    n, place = len(action), np.arange(len(action))
    begins = (action == "touchstart") & (touches == 2)
    sets = begins | (np.isin(action, ("touchend", "touchcancel")) & (touches < 2))
    last = np.maximum.accumulate(np.where(sets, place, -1))
    carried = np.where(starts == 0, apart, 0.0)
    distance = np.where(last >= starts, np.where(begins, amount, 0.0)[last], carried)
    before = np.where(place > starts, np.append(0.0, distance[:-1]), carried)
    maps = nothing(n)
    moves = (action == "touchmove") & (touches == 2) & (before > 0)
    resets = action == "reset"
    scales = ~np.isin(action, ("touchstart", "touchend", "touchcancel", "touchmove", "reset"))
    factor = np.select([action == "in", action == "out", action == "wheel"], [P.ZOOM_STEP, 1 / P.ZOOM_STEP, np.exp(-np.where(action == "wheel", amount, 0.0) * P.ZOOM_PIXEL)], 1.0)
    maps.k[0] = np.select([moves, resets, scales], [amount / np.where(moves, before, 1.0), 0.0, factor], 1.0)
    maps.source[0] = moves
    clamped = moves | scales
    maps.low[0] = np.select([resets, clamped], [1.0, P.MIN_ZOOM], 0.0)
    maps.high[0] = np.select([resets, clamped], [1.0, P.MAX_ZOOM], FREE)
    maps.source[1] = np.where(begins, 0, 1)
    return maps, Pinches(before, distance, begins, moves, ~(moves | resets | scales))


def settled(zoom: np.ndarray, start: np.ndarray, before: np.ndarray, amount: np.ndarray, starts: np.ndarray, pinches: Pinches) -> tuple[np.ndarray, np.ndarray]:
    """Both values with the last step of a pinch done as its definition says, start * amount / distance, so ties round as they do there.

    before is the zoom before the first event.
    """
    place = np.arange(len(zoom))
    last, changed = (np.maximum.accumulate(np.where(x, place, -1)) for x in (pinches.begins, ~pinches.keeps))
    for _ in range(SETTLED):
        moved = np.clip(start * amount / np.where(pinches.moves, pinches.before, 1.0), P.MIN_ZOOM, P.MAX_ZOOM)
        zoom = np.where(pinches.moves, moved, zoom)
        zoom = np.where(changed >= starts, zoom[changed], zoom)
        earlier = np.where(place > starts, np.append(0.0, zoom[:-1]), before)
        start = np.where(last >= starts, earlier[last], start)
    return zoom, start


def _parts(block: pa.Table) -> tuple[pa.Table, np.ndarray, tuple]:
    """A block in order, where each row's session starts, and its events."""
    block = block.sort_by("pos").combine_chunks()
    key = block["session"].combine_chunks()
    n = len(key)
    codes = key.dictionary_encode(null_encoding="encode")
    same = codes.indices.to_numpy() if n else np.zeros(0, np.int64)
    starts = np.maximum.accumulate(np.where(np.append(True, same[1:] != same[:-1])[:n], np.arange(n), 0))
    events = (np.array(block["action"].to_pylist(), dtype=object), block["amount"].to_numpy(), block["touches"].to_numpy())
    return block, starts, events


def _asked(blocks: DataFrame, given: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both ends of blocks by session, in order: a block asks for its first session (role 0) before it gives for its last (1)."""
    none = [F.lit(None).cast(given.schema[c].dataType).alias(c) for c in columns]
    asks = blocks.select(F.col("first").alias("session"), "block", F.lit(0).alias("role"), *none)
    return asks.union(given.select(F.col("last").alias("session"), "block", F.lit(1).alias("role"), *columns))


def zoom_scan(events: DataFrame, session: str, order: list[str], keep: list[str], schema: str) -> DataFrame:
    """keep, zoom, start_zoom and start_distance after each event (action, amount, touches) of a session; schema names and types keep.

    Actions: in, out, reset, wheel (amount in pixels), and touchstart, touchmove,
    touchend, touchcancel with so many touches on the canvas, two of them amount
    apart. A pinch scales the zoom of its start; it needs two touches and ends
    when one leaves. Other actions change nothing; a null amount is 0.
    """
    given = events.select(F.col(session).alias("session"), *order, *[c for c in keep if c not in (session, *order)], "action", F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"), F.coalesce(F.col("touches").cast("int"), F.lit(0)).alias("touches"))
    names = {session: "session"}
    line = [names.get(c, c) for c in order]
    blocks = max(1, -(-given.count() // BLOCK))
    dealt = given.repartitionByRange(blocks, "session", *line).sortWithinPartitions("session", *line)
    placed = written(dealt.withColumns({"block": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), "zoom-events")

    # The distance of a pinch's fingers at a block's begin: the last that was set before.
    sets = ((F.col("action") == "touchstart") & (F.col("touches") == 2)) | (F.col("action").isin("touchend", "touchcancel") & (F.col("touches") < 2))
    runs = placed.groupBy("block", "session").agg(F.min("pos").alias("pos"), F.max_by(F.when(F.col("action") == "touchstart", F.col("amount")).otherwise(0.0), F.when(sets, F.col("pos"))).alias("apart"))
    ends = written(runs.groupBy("block").agg(F.min_by("session", "pos").alias("first"), F.max_by(F.struct("session", "apart"), "pos").alias("end")).select("block", "first", F.col("end.session").alias("last"), F.col("end.apart").alias("apart")), "zoom-blocks")
    before = Window.partitionBy("session").orderBy("block", "role").rowsBetween(Window.unboundedPreceding, -1)
    carried = _asked(ends, ends, ["apart"]).withColumn("apart", F.last("apart", ignorenulls=True).over(before)).where("role = 0").select("block", F.coalesce("apart", F.lit(0.0)).alias("apart"))

    width = [f"{n}{row}" for row in (0, 1) for n in ("k", "low", "high", "source")]
    shape = ", ".join(f"{n} double" for n in width)

    def packed(maps: Maps) -> list[pa.Array]:
        return [pa.array(np.asarray(getattr(maps, n[:-1])[int(n[-1])], float)) for n in width]

    def unpacked(table: pa.Table) -> Maps:
        pair = lambda n: np.stack([table[f"{n}{row}"].to_numpy() for row in (0, 1)])
        return Maps(pair("source").astype(np.int64), pair("k"), pair("low"), pair("high"))

    def summary(block: pa.Table, apart: pa.Table) -> pa.Table:
        block, starts, events = _parts(block)
        done = prefixes(of_events(*events, starts, apart["apart"][0].as_py())[0], starts).take([-1])
        return pa.table([block["block"].slice(0, 1), *packed(done)], names=["block", *width])

    by_block = placed.groupBy("block")
    maps = by_block.cogroup(carried.groupBy("block")).applyInArrow(summary, f"block int, {shape}")
    handed = _asked(ends, maps.join(ends, "block"), width)

    def scanned(rows: pa.Table) -> pa.Table:
        """The state at the begin of each block that asks, from the maps of the blocks before it that end in its session."""
        rows = rows.sort_by([("block", "ascending"), ("role", "ascending")])
        gives = rows["role"].to_numpy() == 1
        before = np.append(0, np.cumsum(gives)[:-1])[~gives]
        maps = unpacked(rows.filter(pa.array(gives)))
        state = prefixes(maps, np.zeros(int(gives.sum()), np.int64)).of(1.0, 1.0)
        state = np.concatenate([np.ones((2, 1)), state], axis=1)[:, before]
        return pa.table([rows["block"].filter(pa.array(~gives)), pa.array(state[0]), pa.array(state[1])], names=["block", "zoom", "start"])

    states = handed.groupBy("session").applyInArrow(scanned, "block int, zoom double, start double").join(carried, "block")

    def rows(block: pa.Table, state: pa.Table) -> pa.Table:
        block, starts, events = _parts(block)
        maps, pinches = of_events(*events, starts, state["apart"][0].as_py())
        zoom, start = (np.where(starts == 0, state[c][0].as_py(), 1.0) for c in ("zoom", "start"))
        done = settled(*prefixes(maps, starts).of(zoom, start), zoom, events[1], starts, pinches)
        return pa.table([*(block[names.get(c, c)] for c in keep), *map(pa.array, done), pa.array(pinches.distance)], names=[*keep, "zoom", "start_zoom", "start_distance"])

    return by_block.cogroup(states.groupBy("block")).applyInArrow(rows, f"{schema}, {STATE}")
