"""Representations of frames: dots, squares, blur rasters and areas, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import scalar as S
from ..operators import contour, coverage, lod, spline, stencil
from ..operators.field import with_field, with_time
from ..sources import lattice
from ..sources.frames import world_to_screen

KEYS = ["frame_id", "i", "j", "lod", "x", "y", "step"]
SCREEN = ["frame_id", "field_pixels", "zoom", "center_x", "center_y"]


def _spacing(step) -> Column:
    return step * F.col("field_pixels") * F.col("zoom")


def _place(df: DataFrame, frames: DataFrame, *more: str) -> DataFrame:
    """Adds screen positions sx and sy and the spacing of cells, and more columns of frames."""
    placed = df.join(frames.select(*SCREEN, *more), "frame_id")
    return placed.withColumns({"sx": world_to_screen(F.col("x"), F.col("center_x")), "sy": world_to_screen(F.col("y"), F.col("center_y")), "spacing": _spacing(F.col("step"))})


def samples(frames: DataFrame) -> DataFrame:
    """Cells in view of each frame, sampled at its level, with hazard states and screen positions."""
    return _place(lod.sample(lattice.view_lattice(with_time(frames)), KEYS), frames)


def _layers(df: DataFrame, radii: dict[str, Column], colours: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row for each layer in which a sample shows, in painting order."""
    each = F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(name).alias("kind"), r.alias("radius"), colours[name].alias("color")) for n, (name, r) in enumerate(radii.items())])
    return df.select(*keep, F.explode(each).alias("l")).select(*keep, "l.*").where("radius > 0")


def dots(sampled: DataFrame) -> DataFrame:
    """Circles of rain and strong rain and symbols of hazards: frame_id, layer, kind, i, j, sx, sy, radius, color."""
    spacing, strong = F.col("spacing"), S.strong_rain(F.col("rain"))
    radii = {"rain": S.radius(F.col("rain"), spacing, "rain"), "strong": S.radius(strong, spacing, "rain"), "hazard": S.hazard_radius(F.col("storm"), F.col("hail"), F.col("state"), spacing)}
    colours = {"rain": F.lit(P.RAIN_HEX), "strong": F.lit(P.STRONG_HEX), "hazard": S.hazard_hex(F.col("state"))}
    return _layers(sampled, radii, colours, ["frame_id", "i", "j", "sx", "sy"])


def colour_cells(df: DataFrame, rain: str, storm: str, hail: str, state: str, spacing: Column, out: str) -> DataFrame:
    """Adds out_r, out_g, out_b. Each overlay is a projection of its own, as each step rounds."""
    names = [f"{out}_{c}" for c in "rgb"]
    col = lambda: [F.col(n) for n in names]
    df = df.withColumns(dict(zip(names, S.rain_colour(F.col(rain), spacing), strict=True)))
    df = df.withColumns(dict(zip(names, S.over_storm(col(), F.col(storm), F.col(state)), strict=True)))
    return df.withColumns(dict(zip(names, S.over_hail(col(), F.col(hail), F.col(state)), strict=True)))


def squares(sampled: DataFrame) -> DataFrame:
    """Drawn cells: frame_id, i, j, x0, y0, size (half a pixel more than the spacing), r, g, b."""
    spacing = F.col("spacing")
    drawn = colour_cells(sampled.where(S.square_drawn(F.col("rain"), F.col("state"), spacing)), "rain", "storm", "hail", "state", spacing, "c")
    return drawn.select("frame_id", "i", "j", (F.col("sx") - spacing / 2).alias("x0"), (F.col("sy") - spacing / 2).alias("y0"), (spacing + 0.5).alias("size"), *[F.col(f"c_{c}").cast("int").alias(c) for c in "rgb"])


def morph_samples(frames: DataFrame) -> DataFrame:
    """Cells of the finer level (fine) with their parents' (fine + 1) values, both with group states.

    frames have fine and progress. Parents are made once each, and give their
    children, at 2 i and 2 i + 1, 2 j and 2 j + 1.
    """
    step, over = F.pow(F.lit(2.0), F.col("fine")) / P.BASE_GRID, 2 * P.OVERSCAN
    ends = {f"{side}_{k}": f(F.col(f"{side}_{c}") / step).cast("long") + d for c, k in (("x", "i"), ("y", "j")) for side, f, d in (("min", F.floor, -over), ("max", F.ceil, over - 1))}
    sized = with_time(frames).withColumns({**ends, "lod": F.col("fine") + 1, "step": 2 * step})
    wide = lattice.cells(sized, *[S.half(F.col(c)) for c in ("min_i", "max_i", "min_j", "max_j")])
    wide = wide.withColumns({"x": (F.col("i") + 0.5) * F.col("step"), "y": (F.col("j") + 0.5) * F.col("step")})
    found = lod.families(wide, [*KEYS, *ends]).withColumnsRenamed({"i": "parent_i", "j": "parent_j", "x": "parent_x", "y": "parent_y"})
    found = found.withColumns({"lod": F.col("lod") - 1, "step": F.col("step") / 2, "i": 2 * F.col("parent_i") + F.col("child") % 2, "j": 2 * F.col("parent_j") + F.floor(F.col("child") / 2)})
    seen = found.where("i between min_i and max_i and j between min_j and max_j").drop("child", *ends)
    seen = seen.withColumns({"x": (F.col("i") + 0.5) * F.col("step"), "y": (F.col("j") + 0.5) * F.col("step")})
    joined = _place(seen, frames.select(*SCREEN, "progress"), "progress")
    return joined.withColumns(
        {
            "parent_sx": world_to_screen(F.col("parent_x"), F.col("center_x")),
            "parent_sy": world_to_screen(F.col("parent_y"), F.col("center_y")),
            "progress": S.smoothstep(0.0, 1.0, S.clamp(F.col("progress"))),
        }
    )


def _moved(df: DataFrame) -> DataFrame:
    p = F.col("progress")
    return df.withColumns({"sx": S.mix(F.col("parent_sx"), F.col("sx"), p), "sy": S.mix(F.col("parent_sy"), F.col("sy"), p)})


def dots_morph(morph: DataFrame) -> DataFrame:
    """Circles between parent and child in place and radius."""
    fine, coarse, p = F.col("spacing"), 2 * F.col("spacing"), F.col("progress")
    between = lambda of: S.mix(of("parent_rain", coarse), of("rain", fine), p)
    radii = {"rain": between(lambda c, s: S.radius(F.col(c), s, "rain")), "strong": between(lambda c, s: S.radius(S.strong_rain(F.col(c)), s, "rain"))}
    return _layers(_moved(morph), radii, {"rain": F.lit(P.RAIN_HEX), "strong": F.lit(P.STRONG_HEX)}, ["frame_id", "i", "j", "sx", "sy"])


def hazard_morph(morph: DataFrame) -> DataFrame:
    """Symbols between parent and child in place; both radii and the state are those of the child's value at a point."""
    point = S.hazard_state(F.col("storm"), F.col("hail"))
    of = lambda s: S.hazard_radius(F.col("storm"), F.col("hail"), F.col("point"), s)
    moved = _moved(morph).withColumn("point", point)
    out = moved.select("frame_id", "i", "j", "sx", "sy", S.mix(of(2 * F.col("spacing")), of(F.col("spacing")), F.col("progress")).alias("radius"), S.hazard_kind(F.col("point")).alias("kind"), S.hazard_hex(F.col("point")).alias("color"))
    return out.where("radius > 0")


def squares_morph(morph: DataFrame, keep: tuple[Column, ...] = ()) -> DataFrame:
    """Cells of the finer level with colours between the parent's and their own; all are drawn. keep: further columns of the cells."""
    spacing = F.col("spacing")
    both = colour_cells(morph, "rain", "storm", "hail", "state", spacing, "fine")
    both = colour_cells(both, "parent_rain", "parent_storm", "parent_hail", "parent_state", 2 * spacing, "coarse")
    mixed = S.mix_colour([F.col(f"coarse_{c}") for c in "rgb"], [F.col(f"fine_{c}") for c in "rgb"], F.col("progress"))
    return both.select("frame_id", "i", "j", (F.col("sx") - spacing / 2).alias("x0"), (F.col("sy") - spacing / 2).alias("y0"), *[m.cast("int").alias(c) for m, c in zip(mixed, "rgb", strict=True)], *keep)


def dots_between(morph: DataFrame) -> DataFrame:
    """Circles and symbols of a transition, with the columns of dots."""
    symbols = hazard_morph(morph).withColumns({"kind": F.lit("hazard"), "layer": F.lit(2)})
    return dots_morph(morph).unionByName(symbols)


def squares_between(morph: DataFrame) -> DataFrame:
    """Cells of a transition, with the columns of squares."""
    return squares_morph(morph, ((F.col("spacing") + 0.5).alias("size"),))


def smooth_grid(frames: DataFrame) -> DataFrame:
    """frame_id, row, col and smoothed channels of each frame's grid; frames have grid_bounds()."""
    grid = with_field(lattice.base_grid(with_time(frames))).select("frame_id", "row", "col", *P.CHANNELS)
    return stencil.gauss_smooth(grid)


def raster_size(of: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(of) * P.RASTER_SCALE).cast("int"))


def raster(frames: DataFrame) -> DataFrame:
    """(frame_id, py, px, channels): the smoothed grid in view, at the centres of raster pixels."""
    bounded = lattice.grid_bounds(frames, bounded=True).where("end_i >= start_i and end_j >= start_j")
    x_axis = spline.raster_axis(bounded, raster_size("width"), F.col("width"), F.col("center_x"), F.col("start_i"), F.col("end_i") - F.col("start_i") + 1)
    y_axis = spline.raster_axis(bounded, raster_size("height"), F.col("height"), F.col("center_y"), F.col("start_j"), F.col("end_j") - F.col("start_j") + 1)
    return spline.reconstruct(smooth_grid(bounded), x_axis, y_axis)


def blur_pixels(values: DataFrame) -> DataFrame:
    """(frame_id, py, px, r, g, b, a) with whole numbers from 0 to 255."""
    rain, storm, hail = (F.col(c) for c in P.CHANNELS)
    green = S.mix(144.0, 0.0, S.smoothstep(0.55, 0.9, rain))
    opacity = {"rain": S.field_opacity(rain, 0.006, 0.52, 0.66), "storm": S.hazard_opacity(storm, 0.006, 0.03375, 0.075, 0.54, 0.76), "hail": S.hazard_opacity(hail, 0.010, 0.0495, 0.11, 0.44)}
    shown = values.select("frame_id", "py", "px", F.lit(0.0).alias("r"), green.alias("g"), F.lit(255.0).alias("b"), opacity["rain"].alias("a"), opacity["storm"].alias("_s"), opacity["hail"].alias("_h"))
    for colour, layer in ((P.STORM_RGB, "_s"), (P.HAIL_RGB, "_h")):
        pixel = S.composite(S.rgb(colour), F.col(layer), [F.col(c) for c in "rgba"])
        shown = shown.withColumns(dict(zip("rgba", pixel, strict=True)))
    return shown.select("frame_id", "py", "px", *[S.nearest(F.col(c)).cast("int").alias(c) for c in "rgb"], S.nearest(F.col("a") * 255.0).cast("int").alias("a"))


def area_grid(frames: DataFrame, smooth: bool) -> tuple[DataFrame, DataFrame]:
    """Frames with grid bounds, and the grid over the whole support, with the margin that generalisation needs."""
    bounded = lattice.grid_bounds(frames, extra=P.GENERAL_RADIUS * P.GENERAL_PASSES if smooth else 0)
    return bounded, smooth_grid(bounded)


def support_bounds(frames: DataFrame) -> DataFrame:
    return frames.withColumns({"low_x": F.col("travel_x") - P.SUPPORT_X, "high_x": F.col("travel_x") + P.SUPPORT_X, "low_y": F.lit(0.5 - P.SUPPORT_Y), "high_y": F.lit(0.5 + P.SUPPORT_Y)})


def remapped_bands(bounded: DataFrame, original: DataFrame, general: DataFrame, bands: DataFrame) -> DataFrame:
    """Thresholds of the generalised grid by frame, from the cells whose centres lie in the support."""
    near = support_bounds(bounded).select("frame_id", "start_i", "start_j", "low_x", "high_x", "low_y", "high_y")
    inside = lambda grid: coverage.within_view(grid.join(near, "frame_id"))
    return coverage.remap(inside(original), inside(general), bands)


def node_bounds(bounded: DataFrame) -> DataFrame:
    """Adds first_i, last_i, first_j, last_j, rows and columns of the contour lattice."""
    step, over = contour.STEP, contour.STEP * 4
    return support_bounds(bounded).withColumns(
        {
            "first_i": F.floor((F.col("low_x") - over) / step).cast("long"),
            "last_i": F.ceil((F.col("high_x") + over) / step).cast("long"),
            "first_j": F.floor((F.col("low_y") - over) / step).cast("long"),
            "last_j": F.ceil((F.col("high_y") + over) / step).cast("long"),
        }
    ).withColumns({"columns": (F.col("last_i") - F.col("first_i") + 1).cast("int"), "rows": (F.col("last_j") - F.col("first_j") + 1).cast("int")})


def contour_cells(bounded: DataFrame, grid: DataFrame, bands: DataFrame) -> DataFrame:
    """Cells of the contour lattice that a band's threshold (frame_id, channel, band, threshold) crosses, with their corners."""
    placed = node_bounds(bounded)
    x_axis = spline.lattice_axis(placed, F.col("first_i"), F.col("last_i"), F.col("start_i"), F.col("end_i") - F.col("start_i") + 1)
    y_axis = spline.lattice_axis(placed, F.col("first_j"), F.col("last_j"), F.col("start_j"), F.col("end_j") - F.col("start_j") + 1)
    return contour.crossings(grid, x_axis, y_axis, bands).join(placed.select("frame_id", "first_i", "first_j", "rows", "columns"), "frame_id")


def areas(loops: DataFrame, frames: DataFrame) -> DataFrame:
    """Loops on the screen in painting order: five rain bands, storm, hail, then outlines of storm and hail.

    frame_id, layer, style, channel, band, loop_id, seq, px, py, color, alpha, line_width (outlines only).
    """
    scale = F.col("field_pixels") * F.col("zoom")
    placed = loops.join(frames.select(*SCREEN), "frame_id").withColumns({"px": world_to_screen(F.col("x"), F.col("center_x")), "py": world_to_screen(F.col("y"), F.col("center_y"))})
    hexes = F.create_map(*[F.lit(x) for c, b, _, h in P.BANDS for x in (f"{c}{b}", h)])
    order = {"rain": F.col("band"), "storm": F.lit(5), "hail": F.lit(6)}
    layer = F.when(F.col("channel") == "rain", order["rain"]).when(F.col("channel") == "storm", order["storm"]).otherwise(order["hail"])
    alpha = F.when(F.col("channel") == "rain", 1.0).when(F.col("channel") == "storm", 0.45).otherwise(0.35)
    fill = F.struct(layer.cast("int").alias("layer"), F.lit("fill").alias("style"), alpha.alias("alpha"), F.lit(None).cast("double").alias("line_width"))
    line = F.struct((layer + 2).cast("int").alias("layer"), F.lit("line").alias("style"), F.lit(1.0).alias("alpha"), (F.lit(1.25) / scale).alias("line_width"))
    styles = F.when(F.col("channel") == "rain", F.array(fill)).otherwise(F.array(fill, line))
    out = placed.select("frame_id", "channel", "band", "loop_id", "seq", "px", "py", hexes[F.concat("channel", F.col("band").cast("string"))].alias("color"), F.explode(styles).alias("s"))
    return out.select("frame_id", "s.layer", "s.style", "channel", "band", "loop_id", "seq", "px", "py", "color", "s.alpha", "s.line_width")


def frame_bands(frames: DataFrame) -> DataFrame:
    """The bands of each frame, with their own thresholds."""
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(b).alias("band"), F.lit(t).alias("threshold")) for c, b, t, _ in P.BANDS])
    return frames.select("frame_id", F.inline(each))


def render(frames: DataFrame, mode: str, smooth: bool = False) -> DataFrame:
    """One representation of frames: dots, squares, blur or areas.

    Dots and squares of frames that are between levels (fine and progress not
    null) are those of the transition.
    """
    still, moving = (frames.where("fine is null"), frames.where("fine is not null")) if "fine" in frames.columns else (frames, None)
    if mode == "dots":
        out = dots(samples(still))
        return out if moving is None else out.unionByName(dots_between(morph_samples(moving)))
    if mode == "squares":
        out = squares(samples(still))
        return out if moving is None else out.unionByName(squares_between(morph_samples(moving)))
    if mode == "blur":
        return blur_pixels(raster(frames))
    if mode != "areas":
        raise ValueError(f"unknown mode {mode}")
    bounded, grid = area_grid(frames, smooth)
    bands = frame_bands(bounded)
    if smooth:
        general = stencil.box_blur(grid)
        bands = remapped_bands(bounded, grid, general, band_table(frames.sparkSession))
        grid = general
    return areas(contour.stitch(contour.segments(contour_cells(bounded, grid, bands))), frames)


def band_table(spark) -> DataFrame:
    return spark.createDataFrame([(c, b, t) for c, b, t, _ in P.BANDS], "channel string, band int, threshold double")
