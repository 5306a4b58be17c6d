"""Cubic B-spline reconstruction of grids at points, on rasters and on lattices.

Reconstruction is separable. An axis table lists, for each output position, its
four source indices (clamped to the grid) and weights. Output rows are cut into
strips; a strip gets the grid rows that its taps name and the axes, and is summed
along one direction, then along the other. One frame spreads over many tasks, and
a task's memory is bounded by a strip.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .. import params as P
from ..functions.scalar import spline_weights
from .stencil import matrix, place

#: Output rows of a strip.
STRIP = 96


def _taps(axis: DataFrame, place: Column, size: Column, single: bool = False) -> DataFrame:
    """axis x 4 taps: src (clamped index) and w for a place in grid units."""
    base = F.floor(place)
    weights = [w.cast("float").cast("double") if single else w for w in spline_weights(place - base)]
    taps = F.array(*[F.struct(F.greatest(F.lit(0), F.least(size - 1, base - 1 + k)).cast("int").alias("src"), w.alias("w")) for k, w in enumerate(weights)])
    return axis.withColumn("_tap", F.explode(taps)).withColumns({"src": F.col("_tap.src"), "w": F.col("_tap.w")}).drop("_tap")


def raster_axis(frames: DataFrame, size: Column, screen: Column, center: Column, start: Column, grid_size: Column) -> DataFrame:
    """(frame_id, pos, src, w) of a raster axis; weights are rounded to 32 bits."""
    axis = frames.select("frame_id", "field_pixels", "zoom", screen.alias("_screen"), center.alias("_center"), start.alias("_start"), grid_size.alias("_size"), size.alias("_n"))
    axis = axis.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    world = (((F.col("pos") + 0.5) / F.col("_n")) * F.col("_screen") - F.col("_center")) / (F.col("field_pixels") * F.col("zoom")) + 0.5
    return _taps(axis, world * P.BASE_GRID - 0.5 - F.col("_start"), F.col("_size"), single=True).select("frame_id", "pos", "src", "w")


def lattice_axis(frames: DataFrame, first: Column, last: Column, start: Column, grid_size: Column) -> DataFrame:
    """(frame_id, pos, src, w) of nodes first to last at a third of the grid's step; pos counts from 0."""
    axis = frames.select("frame_id", first.alias("_first"), last.alias("_last"), start.alias("_start"), grid_size.alias("_size"))
    axis = axis.withColumn("_node", F.explode(F.sequence("_first", "_last"))).withColumn("pos", (F.col("_node") - F.col("_first")).cast("int"))
    place = F.col("_node").cast("double") / P.SUBDIVISIONS - 0.5 - F.col("_start")
    return _taps(axis, place, F.col("_size")).select("frame_id", "pos", "src", "w")


def strips(grid: DataFrame, x_axis: DataFrame, y_axis: DataFrame, channels, strip: int, overlap: int = 0, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What each strip (part) of `strip` output rows, and so many rows of the next one, needs: its grid rows, and its axes.

    more: further rows (frame_id, axis, pos, src, w) that every strip of a frame gets with its axes.
    """
    names = ["pos", "src", "w"]
    parts = F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - overlap) / strip).cast("int")), F.floor(F.col("pos") / strip).cast("int"))
    tall = y_axis.select("frame_id", F.explode(parts).alias("part"), F.lit("y").alias("axis"), *names)
    needed = tall.select("frame_id", F.col("part").alias("strip"), F.col("src").alias("row")).distinct()
    cells = grid.select("frame_id", "row", "col", *channels).join(needed, ["frame_id", "row"])
    wide = x_axis.select("frame_id", F.lit("x").alias("axis"), *names)
    wide = wide if more is None else wide.union(more.select("frame_id", "axis", *names))
    return cells, tall.union(wide.join(tall.select("frame_id", "part").distinct(), "frame_id").select(tall.columns))


def _axis(axes: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in order, and four sources and weights of each."""
    part = axes.filter(pc.equal(axes["axis"], name))
    order = np.argsort(part["pos"].to_numpy(), kind="stable")
    pos, src, w = (part[c].to_numpy()[order] for c in ("pos", "src", "w"))
    return pos[::4], src.reshape(-1, 4), w.reshape(-1, 4)


def dense(cells: pa.Table, axes: pa.Table, channels) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Positions down and across a strip, and each channel there: along x for its grid rows, then along y."""
    px, x_src, x_w = _axis(axes, "x")
    py, y_src, y_w = _axis(axes, "y")
    out, at, first = [], place(cells), cells["row"].to_numpy().min()
    for c in channels:
        v = matrix(cells, c, at)
        lines = sum(v[:, x_src[:, k]] * x_w[:, k] for k in range(4))
        out.append(sum(lines[y_src[:, k] - first] * y_w[:, k, None] for k in range(4)))
    return py, px, out


def repeated(value: pa.ChunkedArray, n: int) -> pa.Array:
    """The first value of a column, n times."""
    return value.slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64)))


def reconstruct(grid: DataFrame, x_axis: DataFrame, y_axis: DataFrame, channels=P.CHANNELS, strip: int | None = None) -> DataFrame:
    """(frame_id, py, px, channels) of the nodes of both axes."""
    cells, axes = strips(grid, x_axis, y_axis, channels, strip or STRIP)
    schema = StructType([grid.schema["frame_id"], StructField("py", IntegerType()), StructField("px", IntegerType()), *(StructField(c, DoubleType()) for c in channels)])

    def run(cells: pa.Table, axes: pa.Table) -> pa.Table:
        if not cells.num_rows:
            return pa.table([axes["frame_id"].slice(0, 0), *(pa.array([], pa.int32()),) * 2, *(pa.array([], pa.float64()),) * len(channels)], names=schema.names)
        py, px, values = dense(cells, axes, channels)
        columns = [repeated(cells["frame_id"], len(py) * len(px)), pa.array(np.repeat(py, len(px)), pa.int32()), pa.array(np.tile(px, len(py)), pa.int32())]
        return pa.table([*columns, *(pa.array(v.ravel()) for v in values)], names=schema.names)

    return cells.groupBy("frame_id", "strip").cogroup(axes.groupBy("frame_id", "part")).applyInArrow(run, schema)


def reconstruct_points(grid: DataFrame, points: DataFrame, channels=P.CHANNELS) -> DataFrame:
    """Channels at points (point_id, frame_id, x, y, start_i, start_j, width, height): 16 taps each."""
    taken = points.select("point_id", "frame_id", "x", "y", "start_i", "start_j", "width", "height")
    by_x = _taps(taken, F.col("x") * P.BASE_GRID - 0.5 - F.col("start_i"), F.col("width")).withColumnsRenamed({"src": "col", "w": "wx"})
    by_y = _taps(by_x, F.col("y") * P.BASE_GRID - 0.5 - F.col("start_j"), F.col("height")).withColumnsRenamed({"src": "row", "w": "wy"})
    met = by_y.join(grid.select("frame_id", "row", "col", *channels), ["frame_id", "row", "col"])
    return met.groupBy("point_id", "frame_id", "x", "y").agg(*[F.sum(F.col(c) * F.col("wx") * F.col("wy")).alias(c) for c in channels])
