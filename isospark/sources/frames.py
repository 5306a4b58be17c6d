"""Frames: viewport, trajectory and level of detail, one row a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import clamp, mix, smoothstep


def continuous_lod(zoom: Column, field_pixels: Column) -> Column:
    return clamp(F.log2(F.lit(P.TARGET_SPACING) / F.greatest(field_pixels * zoom / P.BASE_GRID, F.lit(0.001))), 0.0, 5.0)


def select_lod(zoom: Column, field_pixels: Column) -> Column:
    return F.floor(continuous_lod(zoom, field_pixels) + 0.5).cast("int")


def with_viewport(frames: DataFrame) -> DataFrame:
    """Adds to (width, height, zoom, t): field_pixels, centre, world bounds, travel_x and lod.

    travel_x follows the world at zoom 1, so it does not depend on the zoom.
    """
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    out = frames.withColumns({"field_pixels": 0.92 * F.least(w, h), "center_x": w / 2, "center_y": h / 2 - F.least(F.lit(24.0), 0.025 * h)})
    fp, zoom = F.col("field_pixels"), F.col("zoom")
    left, right = 0.5 - F.col("center_x") / fp, 0.5 + (w - F.col("center_x")) / fp
    return out.withColumns(
        {
            "min_x": 0.5 - F.col("center_x") / (fp * zoom),
            "max_x": 0.5 + (w - F.col("center_x")) / (fp * zoom),
            "min_y": 0.5 - F.col("center_y") / (fp * zoom),
            "max_y": 0.5 + (h - F.col("center_y")) / (fp * zoom),
            "travel_x": mix(mix(left, right, 0.33), mix(left, right, 0.67), smoothstep(0.0, 1.0, F.col("t"))),
            "lod": select_lod(zoom, fp),
        }
    )


def canvas_size(width: Column, height: Column, ratio: Column) -> dict[str, Column]:
    """Sizes of a view and of its canvas: one pixel at least, times the device's ratio (none or zero counts as one)."""
    w, h, dpr = F.greatest(F.lit(1), width), F.greatest(F.lit(1), height), F.when(ratio != 0, ratio).otherwise(1.0)
    pixels = lambda size: F.floor(size * dpr + 0.5)
    return {"width": w, "height": h, "canvas_width": pixels(w), "canvas_height": pixels(h)}


def with_transition(frames: DataFrame, states: DataFrame) -> DataFrame:
    """frames drawn at the level and transition (frame_id, level, fine, progress) of their session's state; without one, at their own level."""
    return frames.drop("fine", "progress").join(states.select("frame_id", "level", "fine", "progress"), "frame_id", "left").withColumn("lod", F.coalesce("level", "lod")).drop("level")


def world_to_screen(world: Column, center: Column) -> Column:
    return center + (world - 0.5) * F.col("field_pixels") * F.col("zoom")
