"""Contours: Marching Squares over a node lattice, and stitching of segments into loops.

Cells are found where the lattice is reconstructed, strip by strip, and only those
that a threshold crosses become rows. Segments are keyed by the edges that they join, never by
coordinates, so cells side by side agree exactly. Loops are ranked by pointer
jumping over edges, and nested by the parity of a ray's crossings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..lineage import discard, written
from . import spline
from .stencil import single

STEP = 1.0 / (P.BASE_GRID * P.SUBDIVISIONS)
#: What a line belongs to.
LINE = ["frame_id", "channel", "band"]
#: Joins of a round of ranking.
HOPS = 3
#: Segments of each case as pairs of edges (top, right, bottom, left); the saddles 5 and 10 depend on the mean.
CASES = {
    1: ("TL",), 2: ("RT",), 3: ("RL",), 4: ("BR",), 6: ("BT",), 7: ("BL",), 8: ("LB",), 9: ("TB",), 11: ("RB",), 12: ("LR",), 13: ("TR",), 14: ("LT",),
    (5, True): ("TR", "BL"), (5, False): ("TL", "RB"), (10, True): ("TL", "RB"), (10, False): ("TR", "BL"),
}


def crossings(grid: DataFrame, x_axis: DataFrame, y_axis: DataFrame, bands: DataFrame, channels=P.CHANNELS, strip: int | None = None) -> DataFrame:
    """(frame_id, row, col, channel, band, threshold, a, b, c, d): cells of the node lattice of both axes with each threshold that passes through them.

    a to d are the corners, clockwise from the top left, rounded to 32 bits.
    bands: frame_id, channel, band, threshold. A strip of the lattice, with the
    first row of the next, is reconstructed in one task, which searches a
    channel's sorted thresholds for those above a cell's lowest corner, up to its
    highest. So nodes are never rows; only hits leave the task.
    """
    steps = bands.select("frame_id", F.col("channel").alias("axis"), F.col("band").cast("int").alias("pos"), F.lit(0).alias("src"), F.col("threshold").cast("double").alias("w"))
    cells, axes = spline.strips(grid, x_axis, y_axis, channels, strip or spline.STRIP, 1, steps)
    kind = grid.schema["frame_id"].dataType.simpleString()
    names = ["frame_id", "row", "col", "channel", "band", "threshold", *"abcd"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), *(pa.float64(),) * 5]

    def run(cells: pa.Table, axes: pa.Table) -> pa.Table:
        found = [[np.zeros(0)] for _ in kinds]
        if cells.num_rows:
            py, px, values = spline.dense(cells, axes, channels)
            for name, v in zip(channels, values, strict=True):
                v = single(v)
                at = [v[:-1, :-1], v[:-1, 1:], v[1:, 1:], v[1:, :-1]]
                of = axes.filter(pc.equal(axes["axis"], name)).sort_by("w")
                band, level = of["pos"].to_numpy(), of["w"].to_numpy()
                low, high = (np.searchsorted(level, f.reduce(at).ravel(), "right") for f in (np.minimum, np.maximum))
                hits = high - low
                cell = np.repeat(np.arange(len(hits)), hits)
                which = np.repeat(low, hits) + np.arange(len(cell)) - np.repeat(np.cumsum(hits) - hits, hits)
                row, col = np.divmod(cell, max(1, len(px) - 1))
                for out, column in zip(found, [py[row], px[col], np.repeat(name, len(cell)), band[which], level[which], *(x.ravel()[cell] for x in at)], strict=True):
                    out.append(column)
        columns = [pa.array(np.concatenate(c[1:] or c), k) for c, k in zip(found, kinds, strict=True)]
        frame = (cells if cells.num_rows else axes)["frame_id"]
        return pa.table([spline.repeated(frame, len(columns[0])), *columns], names=names)

    shape = f"frame_id {kind}, row int, col int, channel string, band int, threshold double, a double, b double, c double, d double"
    return cells.groupBy("frame_id", "strip").cogroup(axes.groupBy("frame_id", "part")).applyInArrow(run, shape)


def _case() -> Column:
    bit = lambda c, n: F.when(F.col(c) >= F.col("threshold"), n).otherwise(0)
    return bit("a", 1) + bit("b", 2) + bit("c", 4) + bit("d", 8)


def segments(cells: DataFrame) -> DataFrame:
    """Segments of crossed cells (frame_id, row, col, channel, band, threshold, a, b, c, d, first_i, first_j, rows, columns).

    first_i and first_j are the lattice's first nodes, rows and columns its numbers of nodes.
    """
    t = F.col("threshold")
    x, y = (F.col("first_i") + F.col("col")) * STEP, (F.col("first_j") + F.col("row")) * STEP
    share = lambda p, q: (t - F.col(p)) / F.when(F.col(q) != F.col(p), F.col(q) - F.col(p)) * STEP
    row, col, wide = F.col("row").cast("long"), F.col("col").cast("long"), F.col("columns").cast("long")
    upright = F.col("rows").cast("long") * (wide - 1) + row * wide + col
    edges = {
        "T": (row * (wide - 1) + col, x + share("a", "b"), y),
        "R": (upright + 1, x + STEP, y + share("b", "c")),
        "B": ((row + 1) * (wide - 1) + col, x + share("d", "c"), y + STEP),
        "L": (upright, x, y + share("a", "d")),
    }
    segment = lambda pair: F.struct(*[v.alias(n) for n, v in zip(("edge_a", "ax", "ay", "edge_b", "bx", "by"), (*edges[pair[0]], *edges[pair[1]]))])
    high, found = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4.0 >= t, None
    for case, pairs in CASES.items():
        hit = F.col("_case") == case if isinstance(case, int) else (F.col("_case") == case[0]) & (high if case[1] else ~high)
        made = F.array(*[segment(p) for p in pairs])
        found = F.when(hit, made) if found is None else found.when(hit, made)
    out = cells.withColumn("_case", _case()).select("frame_id", "channel", "band", "row", "col", F.explode(found).alias("s"))
    return out.select("frame_id", "channel", "band", "row", "col", "s.edge_a", "s.edge_b", "s.ax", "s.ay", "s.bx", "s.by")


def near(found: DataFrame) -> DataFrame:
    """(frame_id, channel, band, edge, x, y, p, q): each edge that a line crosses, and the edges that its line goes on to (q is null at an end)."""
    side = lambda e, f, x, y: F.struct(F.col(e).alias("edge"), F.col(f).alias("other"), F.struct("row", "col", "edge_a", F.col(x).alias("x"), F.col(y).alias("y")).alias("at"))
    sides = found.select(*LINE, F.inline(F.array(side("edge_a", "edge_b", "ax", "ay"), side("edge_b", "edge_a", "bx", "by"))))
    nodes = sides.groupBy(*LINE, "edge").agg(F.min("at").alias("at"), F.min("other").alias("p"), F.max("other").alias("q"))
    return nodes.select(*LINE, "edge", F.col("at.x").alias("x"), F.col("at.y").alias("y"), "p", F.when(F.col("q") != F.col("p"), F.col("q")).alias("q"))


def directions(nodes: DataFrame) -> DataFrame:
    """Both directions of each line: (line, tail, head) with the direction that follows, and what is known from one step.

    A direction stands for the edge at its tail. ahead_tail and ahead_head name
    the direction `steps` further; low is the smallest edge from the tail up to
    there (without it), at so many steps from the tail, and way the edge after
    low. Where a line ends, its last edge has a direction to nowhere (head -1),
    with nothing ahead; last is then the edge at the end.
    """
    to = lambda tail, head, ahead: F.struct(tail.alias("tail"), head.alias("head"), ahead.alias("ahead_head"))
    edge, p, q, none = F.col("edge"), F.col("p"), F.col("q"), F.lit(-1).cast("long")
    into = F.when(q.isNotNull(), F.array(to(p, edge, q), to(q, edge, p))).otherwise(F.array(to(p, edge, none), to(edge, none, F.lit(None).cast("long"))))
    made = nodes.select(*LINE, F.inline(into))
    ends = F.col("ahead_head").isNull()
    return made.select(
        *LINE, "tail", "head", F.when(~ends, F.col("head")).alias("ahead_tail"), "ahead_head", F.when(ends, 0).otherwise(1).cast("long").alias("steps"),
        F.col("tail").alias("low"), F.lit(0).cast("long").alias("at"), F.col("head").alias("way"), F.when(ends, F.col("tail")).alias("last"), F.lit(True).alias("moved"),
    )


def jump(now: DataFrame) -> DataFrame:
    """Every direction that has something ahead, so many times as far: it follows what it points to, HOPS times."""
    known = ("ahead_tail", "ahead_head", "steps", "low", "at", "way", "last")
    there = now.select(*LINE, F.col("tail").alias("ahead_tail"), F.col("head").alias("ahead_head"), *[F.col(c).alias(f"t_{c}") for c in known])
    far = now.where("ahead_tail is not null").withColumn("moved", F.lit(False))
    for _ in range(HOPS):
        met = far.join(there, [*LINE, "ahead_tail", "ahead_head"], "left")
        on, lower = F.col("t_low").isNotNull(), F.coalesce(F.col("t_low") < F.col("low"), F.lit(False))
        pick = lambda new, old, when: F.when(when, new).otherwise(F.col(old)).alias(old)  # noqa: E731, B023
        far = met.select(
            *LINE, "tail", "head", F.col("t_ahead_tail").alias("ahead_tail"), F.col("t_ahead_head").alias("ahead_head"), pick(F.col("steps") + F.col("t_steps"), "steps", on),
            pick(F.col("t_low"), "low", lower), pick(F.col("steps") + F.col("t_at"), "at", lower), pick(F.col("t_way"), "way", lower), pick(F.col("t_last"), "last", on),
            (F.col("moved") | lower | (on & F.col("t_ahead_tail").isNull())).alias("moved"),
        )
    return far.union(now.where("ahead_tail is null").withColumn("moved", F.lit(False)).select(far.columns))


def stitch(found: DataFrame) -> DataFrame:
    """(frame_id, channel, band, loop_id, seq, x, y): closed loops, loop_id the smallest edge, from there to its smaller neighbour.

    Every edge has two segments at most, so a component is a cycle, or a chain at
    the border, which is closed all the same and begins at its smaller end. Both
    directions of all lines are ranked by pointer jumping: each round joins
    every direction with those that it points to and makes it see HOPS + 1 times
    as far, so a loop of n edges takes log(n) rounds and no task ever holds a
    line. Rounds are written to the shared folder.
    """
    nodes = written(near(found), "contour-edges")
    now = written(directions(nodes), "contour-ranks")
    while True:
        after = written(jump(now), "contour-ranks")
        discard(now)
        now = after
        if not now.where("moved").limit(1).count():
            break
    # What still has something ahead goes around.
    around = F.col("ahead_tail").isNotNull()
    each = now.groupBy(*LINE, F.col("tail").alias("edge")).agg(
        F.min("low").alias("loop_id"), F.max(around).alias("cycle"), F.min(F.when(around, F.struct("way", "at"))).alias("c"), F.min(F.when(~around, F.struct("last", "steps"))).alias("e")
    )
    lengths = each.groupBy(*LINE, "loop_id").agg(F.count("*").alias("length"))
    placed = each.join(lengths, [*LINE, "loop_id"]).join(nodes.select(*LINE, "edge", "x", "y"), [*LINE, "edge"])
    seq = F.when(F.col("cycle"), (F.col("length") - F.col("c.at")) % F.col("length")).otherwise(F.col("e.steps"))
    return placed.select(*LINE, "loop_id", seq.cast("int").alias("seq"), "x", "y")


def nest(loops: DataFrame) -> DataFrame:
    """(frame_id, channel, band, loop_id, points, depth, parent_loop): how many loops of its band hold a loop, and the innermost of them.

    Where areas are filled by the even-odd rule, loops of odd depth are holes. A
    loop's first point stands for it, as loops of one threshold don't cross. Only
    loops whose box holds the point are asked, by the parity of their lines that
    a ray from it crosses.
    """
    key = [*LINE, "loop_id"]
    boxes = loops.groupBy(*key).agg(
        F.count("*").alias("points"), F.min_by(F.struct("x", "y"), "seq").alias("p"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]
    )
    inner = boxes.select(*LINE, F.col("loop_id").alias("inner"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    held = (F.col("inner") != F.col("loop_id")) & F.col("px").between(F.col("low_x"), F.col("high_x")) & F.col("py").between(F.col("low_y"), F.col("high_y"))
    asked = boxes.join(inner, LINE).where(held).select(*key, "inner", "px", "py")
    sized = loops.join(boxes.select(*key, "points"), key)
    ahead = sized.select(*key, F.pmod(F.col("seq") - 1, F.col("points")).cast("int").alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    lines = loops.select(*key, "seq", "x", "y").join(ahead, [*key, "seq"])
    met = asked.join(lines, key).where((F.col("y") > F.col("py")) != (F.col("y2") > F.col("py")))
    right = F.col("px") < F.col("x") + (F.col("py") - F.col("y")) / F.when(F.col("y2") != F.col("y"), F.col("y2") - F.col("y")) * (F.col("x2") - F.col("x"))
    holds = met.groupBy(*key, "inner").agg((F.count_if(right) % 2).alias("odd")).where("odd = 1").select(*LINE, F.col("loop_id").alias("outer"), F.col("inner").alias("loop_id"))
    depths = holds.groupBy(*key).agg(F.count("*").alias("depth"))
    # Of the loops around one, each is within the others, so the deepest is the innermost.
    around = holds.join(depths.select(*LINE, F.col("loop_id").alias("outer"), F.col("depth").alias("outer_depth")), [*LINE, "outer"], "left")
    parents = around.groupBy(*key).agg(F.count("*").alias("depth"), F.max_by("outer", F.struct(F.coalesce("outer_depth", F.lit(0)), -F.col("outer"))).alias("parent_loop"))
    return boxes.select(*key, "points").join(parents, key, "left").select(*key, "points", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "parent_loop")
