"""World-anchored lattices made from frames.

Index ranges are sized on the frames, so cells outside the view or the support
are never made. Columns of a frame become rows by explode, first lattice rows,
then, after spreading those over the cluster, the cells of each row; the field's
terms that depend on t are already on the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P


def _indices(first: Column, last: Column) -> Column:
    """first to last, both included; none where last comes before first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def cells(frames: DataFrame, first_i: Column, last_i: Column, first_j: Column, last_j: Column) -> DataFrame:
    """frames x (i, j)."""
    rows = frames.withColumns({"_i": _indices(first_i, last_i), "j": F.explode(_indices(first_j, last_j))})
    return rows.repartition("frame_id", "j").withColumn("i", F.explode("_i")).drop("_i")


def _floor(c: Column) -> Column:
    return F.floor(c).cast("long")


def _ceil(c: Column) -> Column:
    return F.ceil(c).cast("long")


def view_lattice(frames: DataFrame, level: str = "lod", overscan: int = P.OVERSCAN) -> DataFrame:
    """Cells in view at the frame's level, with overscan; the far ends are left out. Adds step, i, j, x, y (cell centres)."""
    frames = frames.withColumn("step", F.pow(F.lit(2.0), F.col(level)) / P.BASE_GRID)
    step = F.col("step")
    out = cells(
        frames,
        _floor(F.col("min_x") / step) - overscan,
        _ceil(F.col("max_x") / step) + overscan - 1,
        _floor(F.col("min_y") / step) - overscan,
        _ceil(F.col("max_y") / step) + overscan - 1,
    )
    return out.withColumns({"x": (F.col("i") + 0.5) * step, "y": (F.col("j") + 0.5) * step})


def grid_bounds(frames: DataFrame, extra: int = 0, bounded: bool = False) -> DataFrame:
    """Adds start_i, end_i, start_j, end_j (included), of the finest grid over the support, within the view if bounded."""
    pad, step = P.SMOOTH_RADIUS + 3 + extra, 1.0 / P.BASE_GRID
    low_x, high_x = F.col("travel_x") - P.SUPPORT_X, F.col("travel_x") + P.SUPPORT_X
    low_y, high_y = F.lit(0.5 - P.SUPPORT_Y), F.lit(0.5 + P.SUPPORT_Y)
    if bounded:
        low_x, high_x = F.greatest(low_x, F.col("min_x")), F.least(high_x, F.col("max_x"))
        low_y, high_y = F.greatest(low_y, F.col("min_y")), F.least(high_y, F.col("max_y"))
    return frames.withColumns(
        {
            "start_i": _floor(low_x / step - 0.5) - pad,
            "end_i": _ceil(high_x / step - 0.5) + pad,
            "start_j": _floor(low_y / step - 0.5) - pad,
            "end_j": _ceil(high_y / step - 0.5) + pad,
        }
    )


def base_grid(frames: DataFrame) -> DataFrame:
    """Cells of the finest grid within grid_bounds(). Adds i, j, row, col, x, y."""
    out = cells(frames, F.col("start_i"), F.col("end_i"), F.col("start_j"), F.col("end_j"))
    step = 1.0 / P.BASE_GRID
    return out.withColumns(
        {"row": (F.col("j") - F.col("start_j")).cast("int"), "col": (F.col("i") - F.col("start_i")).cast("int"), "x": (F.col("i") + 0.5) * step, "y": (F.col("j") + 0.5) * step}
    )
