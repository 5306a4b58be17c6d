import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isospark import params as P
from isospark.functions import scalar as S
from isospark.operators import contour, coverage, spline, stencil
from isospark.operators.field import evaluate, with_field, with_time
from isospark.plans import represent as R
from isospark.sources import frames as FR
from isospark.sources import lattice, world
from isospark.streaming import scan, session


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def frames(spark, rows=((0, 0.5, 1280, 800, 1.0),)):
    return FR.with_viewport(spark.createDataFrame(list(rows), "frame_id long, t double, width int, height int, zoom double"))


def test_field_anchors(spark):
    points = [
        (0.5, 0.47, 0.25, 1.0, 0.576102099446, 0.240775436847),
        (0.5, 0.5, 0.5, 0.936369247746, 0.444700995743, 0.249406110245),
        (0.35, 0.62, 0.75, 0.789271396063, 0.167749297420, 0.018705715867),
        (0.625, 0.39, 0.5, 0.664475079357, 0.861730266730, 0.395526096109),
        (1.42, 0.5, 0.5, 0.000008207014, 0, 0),
        (1.4201, 0.5, 0.5, 0, 0, 0),
        (0.5, 0.5, 0.0, 0, 0, 0),
        (0.5, 0.5, 1.0, 0, 0, 0),
    ]
    df = spark.createDataFrame([(k, float(x), float(y), float(t), 0.5) for k, (x, y, t, *_) in enumerate(points)], "k int, x double, y double, t double, travel_x double")
    for r in evaluate(df).collect():
        assert (r.rain, r.storm, r.hail) == pytest.approx(points[r.k][3:], abs=1e-11)


def test_kernel_and_weights(spark):
    assert P.kernel()[4:] == [0.33249029517173767, 0.23495368659496307, 0.08290718495845795, 0.014608603902161121, 0.0012853809166699648]
    assert sum(one(spark, *[w.alias(f"w{k}") for k, w in enumerate(S.spline_weights(F.lit(0.37)))])) == pytest.approx(1)


def test_scalar_edges(spark):
    assert one(spark, S.clamp(0.5, 0.8, 0.2).alias("v")).v == 0.8
    assert one(spark, S.nearest(F.lit(-0.5)).alias("v")).v == 0
    assert one(spark, S.half(F.lit(-3)).alias("v")).v == -2
    states = one(spark, *[S.hazard_state(F.lit(a), F.lit(b)).alias(n) for n, a, b in (("none", 0.03375, 0.0495), ("storm", 0.034, 0.0), ("full", 0.93, 0.0), ("hail", 0.9, 0.05), ("top", 0.0, 1.0))])
    assert tuple(states) == (0, 1, 3, 4, 6)
    assert list(one(spark, S.hex_to_rgb(F.lit("#0090FF")).alias("v")).v) == [0, 144, 255]
    assert one(spark, S.colour_string(S.rgb(P.HAIL_RGB)).alias("v")).v == "rgb(255 212 0)"


def test_field_is_evaluated_once(spark, tmp_path):
    from isospark import queries as Q

    events = spark.sql("select id event_id, id % 300 user_id, 'a' event_type, timestamp_micros(id * 1237000000) ts, 1.0D value from range(500)").union(spark.sql("select 500L, 1L, 'a', cast(null as timestamp), 1.0D"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    out = Q.band_colors(spark, str(tmp_path))
    parts = sum(c == "rain" for c, *_ in P.COMPONENTS)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("EXP(") == parts
    assert Q.hazard_symbol(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("EXP(") == len(P.COMPONENTS) - parts
    rain = {r.event_id: r.rain for r in Q.event_values(spark, str(tmp_path)).collect()}
    bands = sorted((t, b, h) for c, b, t, h in P.BANDS if c == "rain")
    want = {i: max((b, *bytes.fromhex(h[1:])) for t, b, h in bands if t <= v) for i, v in rain.items() if v is not None and v >= bands[0][0]}
    assert {r.event_id: (r.band, r.r, r.g, r.b) for r in out.collect()} == want and 0 < len(want) < 500


def test_raw_grid_anchor(spark):
    base = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate((0.25, 0.5, 0.75))], "frame_id long, t double, travel_x double")
    bounded = lattice.grid_bounds(base)
    assert tuple(bounded.select("start_i", "end_i", "start_j", "end_j").first()) == (-62, 189, -41, 168)
    grid = with_field(lattice.base_grid(with_time(bounded)))
    want = {0: (52920, 13343, 8050, 2744, 2722, 643, 4126.101607498), 1: (52920, 11525, 7125, 2369, 3087, 632, 3540.006753476), 2: (52920, 11292, 7169, 2238, 3398, 570, 3334.005950395)}
    rows = grid.groupBy("frame_id").agg(
        F.count("*"), F.count_if(F.col("rain") >= 0.027), F.count_if(F.col("rain") >= 0.12), F.count_if(F.col("rain") >= 0.55), F.count_if(F.col("storm") > 0.03375), F.count_if(F.col("hail") > 0.0495), F.sum("rain")
    )
    for r in rows.collect():
        assert tuple(r)[1:] == pytest.approx(want[r.frame_id], abs=1e-6)


def test_lattice_source_takes_filters(spark, monkeypatch):
    """Filters on rows leave fewer partitions, filters on columns shorter rows, and the cells are those of a plain filter."""
    world.register(spark)
    load = lambda: spark.read.format("world_lattice").option("lod", 1).option("travel_x", 0.25).load()
    cells = {(r.i, r.j): (r.x, r.y) for r in load().collect()}
    assert len(cells) == 118 * 98 and all((x, y) == ((i + 0.5) / 64, (j + 0.5) / 64) for (i, j), (x, y) in cells.items())
    for condition, keep in [("j between 10 and 20 and i > 3", lambda i, j: 10 <= j <= 20 and i > 3), ("i = 5", lambda i, j: i == 5), ("j in (1, 4, 90) and i <= 0", lambda i, j: j in (1, 4, 90) and i <= 0), ("x < 0 and j < 0", lambda i, j: i < 0 and j < 0), ("i > 5 and i < 5", lambda i, j: False), ("i > 1 or j > 1", lambda i, j: i > 1 or j > 1)]:
        assert {(r.i, r.j) for r in load().where(condition).collect()} == {c for c in cells if keep(*c)}
    monkeypatch.setattr(world, "CELLS", 1000)
    reader = world.LatticeReader({"lod": "0"})
    whole = len(reader.partitions())
    left = list(reader.pushFilters([world.GreaterThanOrEqual(("j",), 0), world.LessThan(("j",), 10), world.EqualTo(("x",), 1.0)]))
    parts = reader.partitions()
    assert len(left) == 1 and len(parts) < whole / 10 and (parts[0].first_j, parts[-1].last_j) == (0, 9)


def test_viewports(spark):
    made = frames(spark, [(0, 0.5, 1280, 800, 1.0), (1, 0.5, 1280, 800, 0.1), (2, 0.5, 1280, 800, 5.5), (3, 0.5, 900, 900, 1.0), (4, 0.5, 900, 900, 0.1)])
    rows = {r.frame_id: r for r in made.withColumn("level", FR.continuous_lod(F.col("zoom"), F.col("field_pixels"))).collect()}
    assert (rows[0].min_x, rows[0].max_x, rows[0].min_y, rows[0].max_y, rows[0].level) == pytest.approx((-0.369565, 1.369565, -0.016304, 1.070652, 1.0), abs=1e-4)
    assert (rows[2].min_x, rows[2].max_y, rows[2].level) == pytest.approx((0.341897, 0.603755, 0), abs=1e-6)
    assert (rows[1].level, rows[3].level, rows[4].level) == pytest.approx((4.3219, 0.8301, 4.1520), abs=1e-4)
    assert rows[0].travel_x == rows[1].travel_x == rows[2].travel_x


def test_samples_do_not_depend_on_bounds(spark):
    a = R.samples(frames(spark, [(0, 0.5, 1280, 800, 1.0)]))
    b = R.samples(frames(spark, [(0, 0.5, 1000, 800, 1.0)]))
    keys = ["lod", "i", "j", *P.CHANNELS, "state"]
    a, b = ({(r.lod, r.i, r.j): tuple(r) for r in s.select(*keys).collect()} for s in (a, b))
    shared = a.keys() & b.keys()
    assert len(shared) > 1000
    # The trajectory follows the window, so only its shape decides; equal heights and zoom give equal values at equal travel.
    assert {k[0] for k in shared} == {1}


def test_group_states_roll_up(spark):
    """A group's state is the largest of its children's, which stand in the finer lattice."""
    base = frames(spark)
    fine = base.withColumn("lod", F.lit(1)).withColumn("fine", F.lit(1)).withColumn("progress", F.lit(0.5))
    morph = R.morph_samples(fine)
    kids = morph.groupBy("parent_i", "parent_j").agg(F.count("*").alias("n"), F.max(S.group_state(S.hazard_state(F.col("storm"), F.col("hail")))).alias("kids"), F.first("parent_state").alias("state")).where("n = 4")
    assert kids.count() > 500 and kids.where("kids <> state").count() == 0
    assert morph.where("parent_i <> floor(i / 2) or parent_j <> floor(j / 2)").count() == 0 and morph.where("i < 0").count() > 0


def numpy_box(m, r):
    pad = np.pad(m, ((0, 0), (r, r)), "edge")
    return sum(pad[:, k : k + m.shape[1]] for k in range(2 * r + 1)) / (2 * r + 1)


@pytest.mark.parametrize("shape", [(1, 1), (3, 8), (9, 20)])
def test_stencils(spark, shape):
    m = np.random.default_rng(0).random(shape).astype(np.float32).astype(float)
    df = spark.createDataFrame([(0, r, c, float(m[r, c]), 1.0, 0.0) for r in range(shape[0]) for c in range(shape[1])], "frame_id long, row int, col int, rain double, storm double, hail double")
    back = lambda out: np.array([r.rain for r in out.orderBy("row", "col").collect()]).reshape(shape)
    w = np.array(P.kernel())
    smooth = m
    for axis in (1, 0):
        pad = np.pad(smooth, [(0, 0), (4, 4)] if axis else [(4, 4), (0, 0)], "edge")
        smooth = sum(w[k] * (pad[:, k : k + shape[1]] if axis else pad[k : k + shape[0]]) for k in range(9)).astype(np.float32).astype(float)
    got = stencil.gauss_smooth(df)
    assert np.allclose(back(got), smooth, atol=1e-7) and got.where("abs(storm - 1) > 1e-7 or hail <> 0").count() == 0
    blurred = m
    for _ in range(3):
        blurred = numpy_box(numpy_box(blurred, 6).T, 6).T
    assert np.allclose(back(stencil.box_blur(df)), blurred, atol=1e-6)
    assert stencil.box_blur(df, 0) is df


def test_tiles_do_not_show(spark):
    """Rows are the same whatever the tile or strip, over two frames, and no task needs more than a tile with its rim."""
    m = np.random.default_rng(1).random((2, 41, 53)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(f, r, c, float(m[f, r, c]), 1.0, float(r)) for f in range(2) for r in range(41) for c in range(53)], "frame_id long, row int, col int, rain double, storm double, hail double")
    rows = lambda out: sorted(map(tuple, out.collect()))
    for blur in (stencil.gauss_smooth, lambda g, tile: stencil.box_blur(g, 3, 2, tile=tile), lambda g, tile: stencil.box_blur_pass(g, 6, "row", "col", tile=tile), lambda g, tile: stencil.box_blur_pass(g, 6, "col", "row", tile=tile)):
        whole = rows(blur(df, tile=1000))
        assert len(whole) == 2 * 41 * 53
        for tile in (7, 16, 41):
            assert np.allclose(np.array(rows(blur(df, tile=tile))), np.array(whole), rtol=0, atol=1e-9)
    cells = df.withColumn("t", F.explode(stencil._tiles("row", 4, 16))).withColumn("u", F.explode(stencil._tiles("col", 4, 16))).groupBy("frame_id", "t", "u").count()
    assert cells.agg(F.max("count")).first()[0] <= 24 * 24
    bounds = spark.createDataFrame([(0, -3, 125), (1, 0, 60)], "frame_id long, a long, b long")
    axes = [spline.lattice_axis(bounds, F.col("a"), F.col("b"), F.lit(0), F.lit(n)) for n in (53, 41)]
    whole = rows(spline.reconstruct(df, *axes, strip=1000))
    assert len(whole) == 129**2 + 61**2 and np.allclose(np.array(rows(spline.reconstruct(df, *axes, strip=10))), np.array(whole), rtol=0, atol=1e-12)


def test_box_means_are_running_sums():
    v = np.random.default_rng(4).random((9, 31))
    for radius in (1, 6, 40):
        for axis in (0, 1):
            want = numpy_box(v if axis else v.T, radius)
            assert np.allclose(stencil._box(v, radius, axis), want if axis else want.T, atol=1e-6)


def test_thresholds(spark):
    hist = spark.createDataFrame([(0, "rain", 10, 4), (0, "rain", 500, 2), (0, "rain", 1023, 3)], "frame_id long, channel string, bin int, n long")
    wanted = spark.createDataFrame([(0, "rain", k, c) for k, c in enumerate((0, 1, 3, 4, 9, 10))], "frame_id long, channel string, band int, covered long")
    got = {r.band: r.value for r in coverage.thresholds(hist, wanted).collect()}
    assert got == {0: 1.0, 1: (1024 - 1 / 3) / 1024, 2: 1023 / 1024, 3: 500.5 / 1024, 4: 10 / 1024, 5: 0.0}
    same = spark.createDataFrame([(0, b, 0.5) for b in range(5)], "frame_id long, band int, value double")
    steps = [r.threshold for r in coverage.rising(same).orderBy("band").collect()]
    assert steps[0] == 0.5 and all(b > a for a, b in zip(steps, steps[1:]))


SQUARES = [
    ((1, 0, 0, 0), [("T", 0.5, 0), ("L", 0, 0.5)]),
    ((1, 0, 1, 0), [("T", 0.5, 0), ("R", 1, 0.5), ("B", 0.5, 1), ("L", 0, 0.5)]),
    ((0.9, 0, 0.9, 0), [("T", 4 / 9, 0), ("L", 0, 4 / 9), ("R", 1, 5 / 9), ("B", 5 / 9, 1)]),
    ((0, 1, 0, 1), [("T", 0.5, 0), ("L", 0, 0.5), ("R", 1, 0.5), ("B", 0.5, 1)]),
    ((0, 0.9, 0, 0.9), [("T", 5 / 9, 0), ("R", 1, 4 / 9), ("B", 4 / 9, 1), ("L", 0, 5 / 9)]),
    ((0.5, 0.5, 0.5, 0.5), []),
]


def test_marching_squares(spark):
    rows = [(k, 0, 0, "rain", 0, 0.5, *map(float, c), 0, 0, 2, 2) for k, (c, _) in enumerate(SQUARES)]
    df = spark.createDataFrame(rows, "frame_id long, row int, col int, channel string, band int, threshold double, a double, b double, c double, d double, first_i long, first_j long, rows int, columns int")
    edges = {"T": 0, "B": 1, "L": 2, "R": 3}
    got = {k: [] for k in range(len(SQUARES))}
    for r in contour.segments(df).collect():
        got[r.frame_id].append(((r.edge_a, r.ax / contour.STEP, r.ay / contour.STEP), (r.edge_b, r.bx / contour.STEP, r.by / contour.STEP)))
    for k, (_, points) in enumerate(SQUARES):
        want = [tuple((edges[e], pytest.approx(x), pytest.approx(y)) for e, x, y in points[n : n + 2]) for n in range(0, len(points), 2)]
        assert got[k] == want


def test_loops(spark):
    ring = [(0, "rain", 0, 0, k, 10 + k, 10 + (k + 1) % 5, float(k), 0.0, float((k + 1) % 5), 0.0) for k in range(5)]
    chain = [(0, "rain", 0, 1, 0, 7, 3, 7.0, 0.0, 3.0, 0.0), (0, "rain", 0, 1, 1, 3, 5, 3.0, 0.0, 5.0, 0.0)]
    df = spark.createDataFrame(ring + chain, "frame_id long, channel string, band int, row int, col int, edge_a long, edge_b long, ax double, ay double, bx double, by double")
    rows = contour.stitch(df).orderBy("loop_id", "seq").collect()
    assert [(r.loop_id, r.seq, r.x) for r in rows] == [(3, 0, 5.0), (3, 1, 3.0), (3, 2, 7.0)] + [(10, k, float(k)) for k in range(5)]
    assert contour.stitch(df.limit(0)).count() == 0


def walked(segments):
    """(loop, seq) of each edge by walking from the smallest edge, or a chain's smaller end, to the smaller neighbour."""
    near = {}
    for a, b in segments:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for low in sorted(near):
        if low in out:
            continue
        members, todo = {low}, [low]
        while todo:
            for e in near[todo.pop()] - members:
                members.add(e)
                todo.append(e)
        edge = min((e for e in members if len(near[e]) == 1), default=low)
        for seq in range(len(members)):
            out[edge] = low, seq
            edge = min((e for e in near[edge] if e not in out), default=None)
    return out


def test_loops_are_ranked_as_a_walk_would(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for frame in range(2):
        names = iter(rng.permutation(4000).tolist())
        segments = []
        for size, closed in [(3, True), (4, True), (77, True), (128, True), (2, False), (33, False), (300, False), (513, True)]:
            line = [next(names) for _ in range(size)]
            segments += [tuple(rng.permutation(p).tolist()) for p in zip(line, line[1:] + line[:1] if closed else line[1:])]
        rng.shuffle(segments)
        rows += [(frame, "rain", 0, k, 0, a, b, float(a), 0.0, float(b), 0.0) for k, (a, b) in enumerate(segments)]
        want |= {(frame, e): v for e, v in walked(segments).items()}
    df = spark.createDataFrame(rows, "frame_id long, channel string, band int, row int, col int, edge_a long, edge_b long, ax double, ay double, bx double, by double")
    got = {(r.frame_id, int(r.x)): (r.loop_id, r.seq) for r in contour.stitch(df).collect()}
    assert got == want


def test_nesting_of_rings(spark):
    """Rings within rings, a touching-box neighbour, and a ring in a notch of another's box."""
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    notch = [(20, 0), (30, 0), (30, 10), (28, 10), (28, 2), (22, 2), (22, 10), (20, 10)]
    rings = {1: box(0, 0, 10, 10), 2: box(1, 1, 9, 9), 3: box(2, 2, 4, 4), 4: box(5, 5, 8, 8), 5: box(6, 6, 7, 7), 6: notch, 7: box(24, 4, 26, 6)}
    df = spark.createDataFrame([(0, "rain", b, i, k, float(x), float(y)) for b in (0, 1) for i, r in rings.items() if b == 0 or i != 2 for k, (x, y) in enumerate(r)], "frame_id long, channel string, band int, loop_id long, seq int, x double, y double")
    got = {(r.band, r.loop_id): (r.depth, r.parent_loop, r.points) for r in contour.nest(df).collect()}
    assert got == {(0, 1): (0, None, 4), (0, 2): (1, 1, 4), (0, 3): (2, 2, 4), (0, 4): (2, 2, 4), (0, 5): (3, 4, 4), (0, 6): (0, None, 8), (0, 7): (0, None, 4),
                   (1, 1): (0, None, 4), (1, 3): (1, 1, 4), (1, 4): (1, 1, 4), (1, 5): (2, 4, 4), (1, 6): (0, None, 8), (1, 7): (0, None, 4)}


def test_contour_anchors(spark):
    base = frames(spark)
    bounded, grid = R.area_grid(base, False)
    assert grid.agg(F.sum("rain")).first()[0] == pytest.approx(3540.006806, abs=1e-4)
    found = contour.segments(R.contour_cells(bounded, grid, R.frame_bands(bounded))).cache()
    counts = {(r.channel, r.band): r["count"] for r in found.groupBy("channel", "band").count().collect()}
    assert [counts["rain", b] for b in range(5)] + [counts["storm", 0], counts["hail", 0]] == [1494, 1176, 994, 824, 696, 796, 440]
    edges = found.select("channel", "band", F.col("edge_a").alias("e")).union(found.select("channel", "band", "edge_b"))
    assert edges.groupBy("channel", "band", "e").count().where("count <> 2").count() == 0


def test_constant_field_is_kept_by_splines(spark):
    grid = spark.createDataFrame([(0, r, c, 0.25, 1.0, 0.0) for r in range(6) for c in range(7)], "frame_id long, row int, col int, rain double, storm double, hail double")
    bounds = spark.createDataFrame([(0, -3, 25)], "frame_id long, a long, b long")
    axes = [spline.lattice_axis(bounds, F.col("a"), F.col("b"), F.lit(0), F.lit(n)) for n in (7, 6)]
    out = spline.reconstruct(grid, *axes)
    assert out.count() == 29 * 29 and out.where("abs(rain - 0.25) > 1e-12 or abs(storm - 1) > 1e-12").count() == 0


@pytest.mark.parametrize("mode", ["dots", "squares", "blur", "areas"])
def test_render_modes_and_no_frames(spark, mode):
    assert R.render(frames(spark).limit(0), mode).count() == 0
    if mode == "blur":
        pixels = R.render(frames(spark), mode)
        assert pixels.count() == 538 * 336 and pixels.where("least(r, g, b, a) < 0 or greatest(r, g, b, a) > 255").count() == 0
    with pytest.raises(ValueError):
        R.render(frames(spark), "lines")


TRACE = [(0.05, 1), (0.05, 0), (0.05, 0), (0.05, 1), (0.05, 1), (0.05, 3), (0.10, 3), (0.10, 3), (0.10, 3)]
STATES = [(1, None), (1, (1, 0, 0.25, 1)), (1, (1, 0, 0.5, 1)), (1, (1, 0, 0.25, -1)), (1, None), (1, (2, 1, 0.75, -1)), (1, (2, 1, 0.25, -1)), (2, None), (2, (3, 2, 0.5, -1))]
SCHEMA = "seq long, level int, coarse int, fine int, progress double, direction int"


def flat(state):
    level, morph = state
    return (level, *(morph or (None,) * 4))


def test_lod_trace(spark):
    events = spark.createDataFrame([(s, k, d, w) for s in (1, 2) for k, (d, w) in enumerate(TRACE)], "session long, seq long, delta double, desired int")
    batch = session.lod_fold(events, "session", ["seq"], ["seq"], SCHEMA)
    rows = sorted(tuple(r) for r in batch.collect())
    for r in rows:
        assert r[1:] == pytest.approx(flat(STATES[r[0]]), abs=1e-9) if r[2] is not None else r[1:] == flat(STATES[r[0]])


def test_zoom_and_pinch(spark):
    """A pinch scales the zoom of its start, whatever other events do to the zoom meanwhile."""
    steps = [("in", 0.0, 0), ("touchmove", 50.0, 2), ("touchstart", 100.0, 2), ("touchmove", 200.0, 2), ("touchmove", 150.0, 2), ("wheel", 100.0, 0), ("touchmove", 50.0, 2), ("touchstart", 7.0, 1), ("touchend", 0.0, 1), ("touchmove", 900.0, 2), ("reset", 0.0, 0), ("touchstart", 10.0, 2), ("touchmove", 1000.0, 2), ("touchmove", 0.1, 2), ("out", 0.0, 0)]
    events = spark.createDataFrame([(1, k, *x) for k, x in enumerate(steps)], "session long, seq long, action string, amount double, touches int")
    got = [r.zoom for r in scan.zoom_scan(events, "session", ["seq"], ["seq"], "seq long").orderBy("seq").collect()]
    assert got == pytest.approx([1.28, 1.28, 1.28, 2.56, 1.92, 1.92 * math.exp(-0.125), 0.64, 0.64, 0.64, 0.64, 1.0, 1.0, 5.5, 0.1, 0.1])


ACTIONS = ["in", "out", "reset", "wheel", "wheel", "touchstart", "touchmove", "touchmove", "touchmove", "touchend", "touchcancel", "else"]


@pytest.mark.parametrize("block", [20, 333, 250_000])
def test_zoom_scan_equals_steps(spark, monkeypatch, block):
    """One session with most events spreads over the blocks and still has the rows of a step by step walk."""
    monkeypatch.setattr(scan, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = []
    for s, n in [(1, 5), (2, 900), (None, 40), (3, 1), (7, 200)]:
        rows += [(s, k, str(rng.choice(ACTIONS)), None if rng.random() < 0.02 else float(rng.choice([-900, -90, 40, 150, 0.5, 3000])), int(rng.choice([1, 2, 2, 2, 0]))) for k in range(n)]
    want, states = set(), {}
    for s, k, action, amount, touches in rows:
        states[s] = session.zoom_step(states.get(s, (1.0, 1.0, 0.0)), action, amount or 0.0, touches)
        want.add((s, k, *(round(v, 7) for v in states[s])))
    events = spark.createDataFrame(rows, "session long, seq long, action string, amount double, touches int").repartition(3)
    out = scan.zoom_scan(events, "session", ["seq"], ["session", "seq"], "session long, seq long")
    assert {(r[0], r[1], *(round(v + 0.0, 7) for v in r[2:])) for r in out.collect()} == want
    if block == 20:
        dealt = events.repartitionByRange(58, "session", "seq").where("session = 2").select(F.spark_partition_id().alias("p")).distinct().count()
        assert dealt > 10
    assert scan.zoom_scan(events.limit(0), "session", ["seq"], ["seq"], "seq long").count() == 0


def test_scrub_and_modes(spark):
    steps = [("tick", 0, 0.0, 0.05), ("down", 1, 9.0, 0.0), ("tick", 0, 0.0, 0.05), ("move", 2, 1.0, 0.0), ("move", 1, 12.0, 0.0), ("toggle", 0, 0.0, 0.0), ("tick", 0, 0.0, 0.05), ("up", 2, 0.0, 0.0), ("cancel", 1, 0.0, 0.0), ("tick", 0, 0.0, 0.5), ("move", 1, 3.0, 0.0), ("input", 0, 18.0, 0.0), ("tick", 0, 0.0, 0.05), ("up", 1, 0.0, 0.0)]
    events = spark.createDataFrame([(1, k, *x) for k, x in enumerate(steps)], "session long, seq long, action string, pointer int, position double, delta double")
    rows = session.scrub(events, "session", ["seq"], F.col("action"), F.col("pointer"), F.col("position"), F.col("delta")).orderBy("seq").collect()
    assert [r.time for r in rows] == pytest.approx([0.05, 9, 9, 9, 12, 12, 12, 12, 12, 12.1, 12.1, 18, 0.05, 0.05])
    assert [r.playing for r in rows] == [True] + [False] * 4 + [True] * 9
    assert [r.scrubbing for r in rows] == [False] + [True] * 7 + [False] * 6
    out = session.modes(events, "session", ["seq"], F.when(F.col("action") == "up", "areas"), F.when(F.col("seq") == 2, True)).orderBy("seq").collect()
    assert [r.render_mode for r in out] == ["dots"] * 7 + ["areas"] * 7 and [r.area_smooth for r in out] == [False] * 2 + [True] * 12


def test_render_between_levels(spark):
    still = frames(spark)
    states = spark.createDataFrame([(0, 2, 1, 0.5)], "frame_id long, level int, fine int, progress double")
    moving = FR.with_transition(still, states)
    for mode, columns in (("dots", 9), ("squares", 9)):
        out = R.render(moving, mode)
        assert len(out.columns) == columns and out.columns == R.render(still, mode).columns and out.count() > 0
        assert R.render(FR.with_transition(still, states.withColumn("fine", F.lit(None).cast("int"))), mode).count() > 0


def test_clock(spark):
    ticks = spark.createDataFrame([(1, k, 0.5 if k % 2 else 0.05, k == 5) for k in range(400)], "session long, seq long, delta double, flip boolean")
    out = session.clock(ticks, "session", ["seq"], "delta", F.col("flip")).orderBy("seq").collect()
    assert out[4].time == pytest.approx(0.35) and out[399].time == out[4].time and not out[5].playing
    assert one(spark, session.timeline_position(F.lit(120.4), F.lit(20.0), F.lit(200.0)).alias("v")).v == pytest.approx(0.502 * 18)
