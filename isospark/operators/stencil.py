"""Separable stencils over grids (frame_id, row, col and channels): Gaussian smoothing and box blur.

Grids are cut into tiles. Each cell goes to its own tile and, near a border, to
the tiles beside it, as a rim as wide as the stencil reaches in all its passes.
A tile goes through the passes in one task, which may spoil its rim but not the
cells within, so one frame spreads over many tasks, and a task's memory is that of
a tile. Beyond the grid's edge the edge's value counts. Box means come from
running sums, so their cost doesn't depend on the radius.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P

#: Rows and columns of a tile, without its rim.
TILE = 128


def _tiles(at: str, rim: int, tile: int) -> Column:
    """The tiles that need a cell, from the one that its rim begins in to the one that it ends in."""
    first = F.greatest(F.lit(0), F.floor((F.col(at) - rim) / tile))
    return F.sequence(first.cast("int"), F.floor((F.col(at) + rim) / tile).cast("int"))


def by_tile(grid: DataFrame, channels, work: Callable[[np.ndarray], np.ndarray], rows: int, cols: int, tile: int | None = None) -> DataFrame:
    """work(channel as a matrix) for each channel, tile by tile; work may reach so many rows and columns. Grids are full rectangles from 0."""
    names, tile = ["frame_id", "row", "col", *channels], tile or TILE
    spread = grid.select(names).withColumn("tile_row", F.explode(_tiles("row", rows, tile))).withColumn("tile_col", F.explode(_tiles("col", cols, tile)))

    def run(table: pa.Table) -> pa.Table:
        r, c = table["tile_row"][0].as_py() * tile, table["tile_col"][0].as_py() * tile
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        own = (row >= r) & (row < r + tile) & (col >= c) & (col < c + tile)
        if not own.any():
            return table.slice(0, 0).select(names)
        at = place(table)
        kept = tuple(x[own] for x in at)
        done = [pa.array(work(matrix(table, name, at))[kept]) for name in channels]
        mine = table.filter(pa.array(own))
        return pa.table([*(mine[k] for k in names[:3]), *done], names=names)

    return spread.groupBy("frame_id", "tile_row", "tile_col").applyInArrow(run, grid.select(names).schema)


def place(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    row, col = table["row"].to_numpy(), table["col"].to_numpy()
    return row - row.min(), col - col.min()


def matrix(table: pa.Table, channel: str, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    shape = at[0].max() + 1, at[1].max() + 1
    if shape[0] * shape[1] != table.num_rows:
        raise ValueError(f"a grid of {shape[0]} x {shape[1]} cells has {table.num_rows} rows")
    out = np.empty(shape)
    out[at] = table[channel].to_numpy()
    return out


def single(values: np.ndarray) -> np.ndarray:
    """Rounded to 32 bits, as stored."""
    return values.astype(np.float32).astype(float)


def weighted(values: np.ndarray, weights, axis: int) -> np.ndarray:
    """Sum of neighbours along an axis, by weights of the places around, first to last."""
    radius, n = len(weights) // 2, values.shape[axis]
    padded = np.pad(values, [(radius, radius) if k == axis else (0, 0) for k in range(2)], mode="edge")
    out = 0.0
    for k, w in enumerate(weights):
        out = out + np.take(padded, range(k, k + n), axis=axis) * w
    return out


def gauss_smooth(grid: DataFrame, channels=P.CHANNELS, tile: int | None = None) -> DataFrame:
    """Nine taps in each direction; values are rounded to 32 bits when stored, before and after each pass."""
    weights = P.kernel()
    reach = len(weights) // 2
    return by_tile(grid, channels, lambda v: single(weighted(single(weighted(single(v), weights, 1)), weights, 0)), reach, reach, tile)


def _box(values: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """Means of 2 * radius + 1 places: a difference of running sums, and an edge's value for each place beyond it.

    Sums are kept as whole numbers of a small enough power of two, so they are
    exact and a mean doesn't depend on where its tile begins.
    """
    v = np.moveaxis(values, axis, 0)
    n, most = len(v), float(np.abs(v).max())
    unit = 2.0 ** (61 - np.frexp(most * (n + 2 * radius + 1))[1]) if most > 0 else 1.0
    v = np.rint(v * unit).astype(np.int64)
    sums = np.concatenate([np.zeros_like(v[:1]), np.cumsum(v, axis=0)])
    at = np.arange(n)
    inside = sums[np.minimum(at + radius, n - 1) + 1] - sums[np.maximum(at - radius, 0)]
    before, beyond = np.maximum(radius - at, 0), np.maximum(at + radius - (n - 1), 0)
    total = (inside + before[:, None] * v[0] + beyond[:, None] * v[-1]) / unit
    return np.moveaxis(single(total / (2 * radius + 1)), 0, axis)


def box_blur_pass(grid: DataFrame, radius: int, across: str, along: str, channels=P.CHANNELS, tile: int | None = None) -> DataFrame:
    """One pass of means of 2 * radius + 1 cells along a direction (col: horizontal)."""
    flat = along == "col"
    return by_tile(grid, channels, lambda v: _box(v, radius, 1 if flat else 0), 0 if flat else radius, radius if flat else 0, tile)


def box_blur(grid: DataFrame, radius: int = P.GENERAL_RADIUS, passes: int = P.GENERAL_PASSES, channels=P.CHANNELS, tile: int | None = None) -> DataFrame:
    """Horizontal and vertical means of 2 * radius + 1 cells, passes times; the grid itself without radius or passes."""
    if radius <= 0 or passes <= 0:
        return grid

    def blur(values: np.ndarray) -> np.ndarray:
        for _ in range(passes):
            values = _box(_box(values, radius, 1), radius, 0)
        return values

    return by_tile(grid, channels, blur, radius * passes, radius * passes, tile)
