"""Queries over the test tables, one for each operator family.

The field has no input tables, so tables are bound to it: events and lineitem
as points, customer and region as frames (areas and contours over the five
frames of region). All queries run over whole tables.
Real numbers are rounded to 6 places, and large lattices are summed by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import params as P
from .functions import scalar as S
from .operators import contour, coverage, spline, stencil
from .operators.field import evaluate, with_field, with_time
from .plans import represent as R
from .sources import frames as FR
from .sources import lattice, world
from .streaming import scan, session


SCREEN = ("sx", "sy", "x0", "y0", "ax", "ay", "bx", "by")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str | None = None):
    """To 6 places; positions to 9, as halves of a millionth are common there."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 9 if (name or c) in SCREEN else 6) + 0.0).alias(name or c)


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 86_400_000_000
    micros = F.unix_micros(F.to_timestamp_ltz(F.col("ts").cast("string")))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "ts", "value",
        (F.pmod(micros, F.lit(day)) / day).alias("t"),
        ((F.col("user_id") % 128 + 0.5) / 128).alias("x"),
        ((F.col("event_id") % 128 + 0.5) / 128).alias("y"),
        F.lit(0.5).alias("travel_x"),
    )


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(event_points(spark, sf_dir))


def region_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    return FR.with_viewport(
        table(spark, sf_dir, "region").select(
            k.cast("long").alias("frame_id"), ((k + 1) / 6).alias("t"), F.when(k % 2 == 0, 1280).otherwise(900).alias("width"), F.when(k % 2 == 0, 800).otherwise(900).alias("height"),
            (0.4 + k * 0.3).alias("zoom"), (k % 3).cast("int").alias("fine"), ((k + 1) / 7).alias("progress"),
        )
    )


def customer_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return FR.with_viewport(
        table(spark, sf_dir, "customer").select(
            k.alias("frame_id"), ((k % 97) / 97).alias("t"), (600 + k % 1400).cast("int").alias("width"), (400 + k % 900).cast("int").alias("height"), (0.1 + (k % 55) * 0.1).alias("zoom"),
        )
    )


def by_row(grid: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """A grid summed by row, plainly and weighted by place."""
    sums = [r6(F.sum(F.col(c) * w), f"{p}_{c}") for c in P.CHANNELS for p, w in (("sum", F.lit(1.0)), ("at", F.col(col) + 1))]
    return grid.groupBy("frame_id", F.col(row).alias("row")).agg(F.count("*").alias("n"), *sums)


def grid_of(frames: DataFrame, extra: int = 0) -> DataFrame:
    return with_field(lattice.base_grid(with_time(lattice.grid_bounds(frames, extra)))).select("frame_id", "row", "col", *P.CHANNELS)


def events_hazard_counts(spark, d):
    state = S.hazard_state(F.col("storm"), F.col("hail"))
    return event_values(spark, d).groupBy("event_type", state.alias("hazard_state")).agg(F.count("*").alias("n"), r6(F.avg("rain"), "avg_rain"))


def field_lattice(spark, d):
    return by_row(grid_of(region_frames(spark, d)))


def lattice_band_counts(spark, d):
    counts = coverage.coverage_counts(coverage.long_form(grid_of(region_frames(spark, d))), R.band_table(spark))
    return counts.select("frame_id", "channel", "band", "covered")


def cell_events(spark, d):
    """Events in each cell of level 2 over the unit square, those without any too."""
    world.register(spark)
    n = P.BASE_GRID // 4
    cells = spark.read.format("world_lattice").option("lod", 2).load().where(f"i >= 0 and i < {n} and j >= 0 and j < {n}")
    at = lambda c: F.floor(F.col(c) * n).cast("long")
    counts = event_points(spark, d).groupBy(at("x").alias("i"), at("y").alias("j")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return cells.join(counts, ["i", "j"], "left").select("i", "j", r6("x"), r6("y"), F.coalesce("n", F.lit(0)).alias("n"), r6("mean"))


def point_field_lineitem(spark, d):
    points = table(spark, d, "lineitem").select(
        "l_returnflag", "l_linestatus", ((F.col("l_partkey") % 128 + 0.5) / 128).alias("x"), ((F.col("l_suppkey") % 128 + 0.5) / 128).alias("y"), (F.col("l_quantity") / 51).alias("t"), F.lit(0.5).alias("travel_x")
    )
    out = evaluate(points).groupBy("l_returnflag", "l_linestatus")
    return out.agg(F.count("*").alias("n"), *[r6(F.sum(c), f"sum_{c}") for c in P.CHANNELS], *[r6(F.max(c), f"max_{c}") for c in P.CHANNELS])


def strength(spark, d):
    return event_values(spark, d).select("event_id", *[r6(S.strength(F.col(c), c), c) for c in P.CHANNELS])


def hazard_state(spark, d):
    state = S.hazard_state(F.col("storm"), F.col("hail"))
    return event_values(spark, d).select("event_id", state.alias("state"), S.hazard_kind(state).alias("kind"), S.hazard_hex(state).alias("color"))


def dot_radius(spark, d):
    return event_values(spark, d).select("event_id", *[r6(S.radius(F.col(c), 11.5, c), c) for c in P.CHANNELS])


def strong_rain(spark, d):
    strong = S.strong_rain(F.col("rain"))
    return event_values(spark, d).select("event_id", r6(strong, "strong"), r6(S.radius(strong, 11.5, "rain"), "radius"))


def square_color(spark, d):
    values = event_values(spark, d).withColumn("state", S.hazard_state(F.col("storm"), F.col("hail")))
    out = R.colour_cells(values, "rain", "storm", "hail", "state", F.lit(11.5), "c")
    return out.select("event_id", *[F.col(f"c_{c}").cast("int").alias(c) for c in "rgb"], S.colour_string([F.col(f"c_{c}") for c in "rgb"]).alias("css"), S.square_drawn(F.col("rain"), F.col("state"), F.lit(11.5)).alias("drawn"))


def _symbols(spark, d):
    values = event_values(spark, d).withColumn("state", S.hazard_state(F.col("storm"), F.col("hail")))
    symbol = F.struct(S.hazard_kind(F.col("state")).alias("kind"), S.hazard_radius(F.col("storm"), F.col("hail"), F.col("state"), 11.5).alias("radius"))
    # As in band_colors: rows of an array, since a filter would evaluate the field once more for each use of state and radius.
    return values.select("event_id", "x", "y", F.inline(F.filter(F.array(symbol), lambda s: s.radius > 0)))


def hazard_symbol(spark, d):
    return _symbols(spark, d).select("event_id", "kind", r6("radius"))


def symbol_vertices(spark, d):
    made = _symbols(spark, d).select("event_id", F.inline(S.symbol_vertices(F.col("x"), F.col("y"), F.col("radius"), F.col("kind"))))
    return made.select("event_id", "point", r6("px"), r6("py"))


def band_colors(spark, d):
    """The colour of the highest rain band that each event reaches."""
    rain = sorted((b, t, h) for c, b, t, h in P.BANDS if c == "rain")
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(t).alias("t"), F.lit(h).alias("color")) for b, t, h in rain])
    reached = F.filter(bands, lambda b: b.t <= F.col("rain"))
    # Rows come of the array: a filter on it would move below the field and evaluate all of it once more for each band.
    shown = event_values(spark, d).select("event_id", F.inline(F.slice(reached, -1, 1)))
    rgb = S.hex_to_rgb(F.col("color"))
    return shown.select("event_id", "band", *[rgb[k].alias(c) for k, c in enumerate("rgb")])


def blur_opacity(spark, d):
    rain, storm, hail = (F.col(c) for c in P.CHANNELS)
    made = {"rain": S.field_opacity(rain, 0.006, 0.52, 0.66), "storm": S.hazard_opacity(storm, 0.006, 0.03375, 0.075, 0.54, 0.76), "hail": S.hazard_opacity(hail, 0.010, 0.0495, 0.11, 0.44)}
    return event_values(spark, d).select("event_id", *[r6(v, c) for c, v in made.items()])


def viewport_bounds(spark, d):
    return customer_frames(spark, d).select("frame_id", *[r6(c) for c in ("field_pixels", "center_x", "center_y", "min_x", "max_x", "min_y", "max_y")])


def travel_path(spark, d):
    return customer_frames(spark, d).select("frame_id", r6("travel_x"))


def select_lod(spark, d):
    lod = FR.continuous_lod(F.col("zoom"), F.col("field_pixels"))
    return customer_frames(spark, d).select("frame_id", "lod", r6(lod, "continuous"))


def lod_sample(spark, d):
    return R.samples(region_frames(spark, d)).select("frame_id", "lod", "i", "j", *[r6(c) for c in (*P.CHANNELS, "sx", "sy")])


def lod_hazard_group(spark, d):
    return R.samples(region_frames(spark, d)).groupBy("frame_id", "lod", "state").agg(F.count("*").alias("n"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j"))


def dots_layers(spark, d):
    return R.dots(R.samples(region_frames(spark, d))).select("frame_id", "layer", "kind", "i", "j", "color", *[r6(c) for c in ("sx", "sy", "radius")])


def squares_cells(spark, d):
    return R.squares(R.samples(region_frames(spark, d))).select("frame_id", "i", "j", "r", "g", "b", *[r6(c) for c in ("x0", "y0", "size")])


def lod_parent_join(spark, d):
    out = R.morph_samples(region_frames(spark, d))
    return out.select("frame_id", "i", "j", "parent_i", "parent_j", "state", "parent_state", *[r6(f"parent_{c}") for c in P.CHANNELS], r6("progress"))


def dots_morph(spark, d):
    return R.dots_morph(R.morph_samples(region_frames(spark, d))).select("frame_id", "layer", "i", "j", *[r6(c) for c in ("sx", "sy", "radius")])


def hazard_morph(spark, d):
    return R.hazard_morph(R.morph_samples(region_frames(spark, d))).select("frame_id", "i", "j", "kind", "color", *[r6(c) for c in ("sx", "sy", "radius")])


def squares_morph(spark, d):
    return R.squares_morph(R.morph_samples(region_frames(spark, d))).select("frame_id", "i", "j", "r", "g", "b", r6("x0"), r6("y0"))


def gauss_smooth(spark, d):
    return by_row(stencil.gauss_smooth(grid_of(region_frames(spark, d))))


def box_blur(spark, d):
    return by_row(stencil.box_blur_pass(grid_of(region_frames(spark, d)), P.GENERAL_RADIUS, "row", "col"))


def box_blur_3pass(spark, d):
    return by_row(stencil.box_blur(grid_of(region_frames(spark, d), 18)))


def spline_raster(spark, d):
    return by_row(R.raster(region_frames(spark, d)), "py", "px")


def spline_lattice(spark, d):
    bounded, grid = R.area_grid(region_frames(spark, d), False)
    placed = R.node_bounds(bounded)
    axes = [spline.lattice_axis(placed, F.col(f"first_{k}"), F.col(f"last_{k}"), F.col(f"start_{k}"), F.col(f"end_{k}") - F.col(f"start_{k}") + 1) for k in "ij"]
    return by_row(spline.reconstruct(grid, *axes), "py", "px")


def spline_points(spark, d):
    bounded, grid = R.area_grid(region_frames(spark, d), False)
    sizes = bounded.select("frame_id", "start_i", "start_j", (F.col("end_i") - F.col("start_i") + 1).alias("width"), (F.col("end_j") - F.col("start_j") + 1).alias("height"))
    points = event_points(spark, d).select(F.col("event_id").alias("point_id"), (F.col("event_id") % 5).alias("frame_id"), "x", "y").join(sizes, "frame_id")
    return spline.reconstruct_points(grid, points).select("point_id", *[r6(c) for c in P.CHANNELS])


def blur_raster(spark, d):
    pixels = R.blur_pixels(R.raster(region_frames(spark, d)))
    return pixels.groupBy("frame_id", "py").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in "rgba"], F.sum(F.col("a").cast("long") * F.col("px")).alias("at_a"))


def coverage_histogram(spark, d):
    return coverage.histogram(coverage.long_form(grid_of(region_frames(spark, d))))


def coverage_threshold(spark, d):
    grid = grid_of(region_frames(spark, d))
    values = coverage.long_form(grid)
    targets = coverage.coverage_counts(values, R.band_table(spark)).select("frame_id", "channel", "band", "covered")
    general = coverage.long_form(stencil.box_blur_pass(grid, P.GENERAL_RADIUS, "row", "col"))
    return coverage.thresholds(coverage.histogram(general), targets).select("frame_id", "channel", "band", "covered", r6("value"))


def _smooth_areas(spark, d):
    bounded, grid = R.area_grid(region_frames(spark, d), True)
    general = stencil.box_blur(grid)
    return bounded, grid, general, R.remapped_bands(bounded, grid, general, R.band_table(spark))


def coverage_bands(spark, d):
    return _smooth_areas(spark, d)[3].select("frame_id", "channel", F.col("band").cast("int").alias("band"), r6("threshold"))


def _cells(spark, d):
    bounded, grid = R.area_grid(region_frames(spark, d), False)
    return R.contour_cells(bounded, grid, R.frame_bands(bounded))


def contour_cells(spark, d):
    return _cells(spark, d).select("frame_id", "channel", "band", "row", "col", *[r6(c) for c in "abcd"])


def contour_segments(spark, d):
    return contour.segments(_cells(spark, d)).select("frame_id", "channel", "band", "row", "col", "edge_a", "edge_b", *[r6(c) for c in ("ax", "ay", "bx", "by")])


def contour_loops(spark, d):
    loops = contour.stitch(contour.segments(_cells(spark, d)))
    return loops.groupBy("frame_id", "channel", "band", "loop_id").agg(F.count("*").alias("points"), r6(F.sum("x"), "sum_x"), r6(F.sum("y"), "sum_y"), r6(F.sum(F.col("seq") * F.col("x")), "at_x"), r6(F.sum(F.col("seq") * F.col("y")), "at_y"))


def loop_nesting(spark, d):
    return contour.nest(contour.stitch(contour.segments(_cells(spark, d))))


def _areas(spark, d, smooth):
    frames = region_frames(spark, d)
    out = R.render(frames, "areas", smooth)
    return out.groupBy("frame_id", "layer", "style", "channel", "band", "color", r6("alpha"), r6("line_width")).agg(F.count("*").alias("points"), r6(F.sum("px"), "sum_px"), r6(F.sum("py"), "sum_py"))


def area_layers(spark, d):
    return _areas(spark, d, False)


def area_layers_smooth(spark, d):
    return _areas(spark, d, True)


def timeline_fold(spark, d):
    events = event_points(spark, d).withColumn("delta", (F.col("event_id") % 15) / 100)
    out = session.clock(events, "user_id", ["ts", "event_id"], "delta", F.col("event_type") == "click")
    return out.select("event_id", "playing", r6("time"))


def timeline_pointer(spark, d):
    return event_points(spark, d).select("event_id", r6(session.timeline_position(F.col("value"), F.lit(20.0), F.lit(400.0)), "time"), r6(session.touch_distance(F.col("x"), F.col("y"), F.col("t"), F.col("travel_x")), "distance"))


def zoom_fold(spark, d):
    n = F.col("event_id")
    touch = F.when(n % 7 == 0, "touchstart").when(n % 7 == 6, "touchend").otherwise("touchmove")
    kind = reduce(lambda w, p: w.when(F.col("event_type") == p[0], p[1]), [("signup", "in"), ("purchase", "out"), ("error", "reset"), ("view", "wheel")], F.when(F.col("event_type") == "click", touch))
    amount = F.when(F.col("event_type") == "view", (F.col("value") - 250) * 4).otherwise((40 + n % 200).cast("double"))
    events = event_points(spark, d).withColumns({"action": kind, "amount": amount, "touches": F.when(n % 5 < 4, 2).otherwise(1)})
    return scan.zoom_scan(events, "user_id", ["ts", "event_id"], ["event_id"], "event_id long").select("event_id", r6("zoom"))


def pinch_fold(spark, d):
    n = F.col("event_id")
    kind = F.when(n % 8 == 0, "touchstart").when(n % 8 == 6, "touchend").when(n % 8 == 7, "wheel").otherwise("touchmove")
    amount = F.when(kind == "wheel", F.col("value") - 250).otherwise((n * 13 % 300).cast("double"))
    events = event_points(spark, d).withColumns({"action": kind, "amount": amount, "touches": F.when(n % 11 < 9, 2).otherwise(1)})
    out = scan.zoom_scan(events, "user_id", ["ts", "event_id"], ["event_id"], "event_id long")
    return out.select("event_id", r6("zoom"), r6("start_zoom"), r6("start_distance"))


def scrub_fold(spark, d):
    n = F.col("event_id")
    last = F.when(n % 3 == 0, "up").when(n % 3 == 1, "cancel").otherwise("input")
    action = reduce(lambda w, p: w.when(F.col("event_type") == p[0], p[1]), [("view", "tick"), ("purchase", "down"), ("signup", "move"), ("error", last)], F.when(F.col("event_type") == "click", "toggle"))
    position = session.timeline_position(F.col("value"), F.lit(20.0), F.lit(400.0))
    out = session.scrub(event_points(spark, d), "user_id", ["ts", "event_id"], action, n % 2, position, (n % 15) / 100)
    return out.select("event_id", "playing", "scrubbing", r6("time"))


def mode_fold(spark, d):
    n = F.col("event_id")
    mode = F.when(F.col("event_type") == "click", F.element_at(F.array(*map(F.lit, ("dots", "squares", "blur", "areas"))), (n % 4 + 1).cast("int")))
    out = session.modes(event_points(spark, d), "user_id", ["ts", "event_id"], mode, F.when(F.col("event_type") == "signup", n % 2 == 0))
    return out.select("event_id", "render_mode", "area_smooth")


def canvas_size(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("frame_id"), *[c.alias(name) for name, c in FR.canvas_size(k * 37 % 1500 - 40, k * 53 % 900 - 20, (k % 5) / 2).items()])


def _moving_frames(spark, d):
    """The frames of region, every second one between levels."""
    moving = F.col("r_regionkey") % 2 == 1
    states = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("frame_id"), (F.col("r_regionkey") % 3).cast("int").alias("level"), *[F.when(moving, c).alias(n) for n, c in (("fine", (F.col("r_regionkey") % 3).cast("int")), ("progress", (F.col("r_regionkey") + 1) / 7))])
    return FR.with_transition(region_frames(spark, d), states)


def render_dots(spark, d):
    return R.render(_moving_frames(spark, d), "dots").select("frame_id", "layer", "kind", "i", "j", "color", *[r6(c) for c in ("sx", "sy", "radius")])


def render_squares(spark, d):
    return R.render(_moving_frames(spark, d), "squares").select("frame_id", "i", "j", "r", "g", "b", *[r6(c) for c in ("x0", "y0", "size")])


def lod_transition_fold(spark, d):
    events = event_points(spark, d).withColumns({"delta": 0.02 + (F.col("event_id") % 5) * 0.02, "desired": ((F.col("event_id") * 7 + F.col("user_id")) % 6).cast("int")})
    out = session.lod_fold(events, "user_id", ["ts", "event_id"], ["event_id"], "event_id long, level int, coarse int, fine int, progress double, direction int")
    return out.select("event_id", "level", "coarse", "fine", r6("progress"), "direction")


NAMES = (
    "events_hazard_counts field_lattice lattice_band_counts cell_events point_field_lineitem strength hazard_state dot_radius strong_rain square_color hazard_symbol symbol_vertices band_colors blur_opacity "
    "viewport_bounds travel_path select_lod lod_sample lod_hazard_group lod_parent_join dots_layers squares_cells dots_morph hazard_morph squares_morph gauss_smooth box_blur box_blur_3pass "
    "spline_raster spline_lattice spline_points blur_raster coverage_histogram coverage_threshold coverage_bands contour_cells contour_segments contour_loops loop_nesting area_layers area_layers_smooth "
    "timeline_fold timeline_pointer zoom_fold pinch_fold scrub_fold mode_fold canvas_size render_dots render_squares lod_transition_fold"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
