"""Level-of-detail sampling: 3 x 3 aggregates, hazard rollup, parent lookup.

A coarse cell is not the mean of finer cells: it evaluates the field at nine
probes. Its hazard state looks at its four children, each sampled at its own
level. All probes of a cell are made from its row, so both aggregates run within
the partition that made the cell; nothing is shuffled after the lattice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import group_state, hazard_state, mix
from .field import with_field

OFFSETS = (-0.34, 0.0, 0.34)


def _probe(child: int, dx, dy) -> Column:
    return F.struct(F.lit(child).alias("child"), (F.lit(0.0) + dx).alias("dx"), (F.lit(0.0) + dy).alias("dy"))


def _nine(child: int, dx, dy, span) -> list[Column]:
    return [_probe(child, dx + ox * span, dy + oy * span) for oy in OFFSETS for ox in OFFSETS]


def probes(level: Column, children: bool = True) -> Column:
    """The places to evaluate for a cell: its own (child -1) and its children's (0 to 3), relative to its centre."""
    span = F.pow(F.lit(2.0), level) / P.BASE_GRID
    own = F.when(level > 0, F.array(*_nine(-1, F.lit(0.0), F.lit(0.0), span))).otherwise(F.array(_probe(-1, 0.0, 0.0)))
    if not children:
        return own
    places = [(k, span * (0.25 if k % 2 else -0.25), span * (0.25 if k // 2 else -0.25)) for k in range(4)]
    points = F.array(*[_probe(*p) for p in places])
    nines = F.array(*[q for p in places for q in _nine(*p, span / 2)])
    return F.concat(own, F.when(level > 1, nines).when(level > 0, points).otherwise(F.array().cast(points_type())))


def points_type() -> str:
    return "array<struct<child:int,dx:double,dy:double>>"


def sample(cells: DataFrame, keys: list[str], level: str = "lod", state: bool = True) -> DataFrame:
    """keys, rain, storm, hail and, where wanted, state, of cells (x, y, travel_x, level, prepared by with_time()).

    keys name the cells and hold all columns to keep, level among them.
    """
    probed = cells.withColumn("_p", F.explode(probes(F.col(level), state)))
    probed = probed.withColumns({"_x": F.col("x") + F.col("_p.dx"), "_y": F.col("y") + F.col("_p.dy"), "_child": F.col("_p.child")})
    valued = with_field(probed, "_x", "_y").select(*keys, "_child", *P.CHANNELS)
    each = valued.groupBy(*keys, "_child").agg(
        F.avg("rain").alias("rain"), mix(F.avg("storm"), F.max("storm"), 0.58).alias("storm"), mix(F.avg("hail"), F.max("hail"), 0.72).alias("hail")
    )
    own = F.col("_child") < 0
    picked = [F.max(F.when(own, F.col(c))).alias(c) for c in P.CHANNELS]
    if not state:
        return each.groupBy(*keys).agg(*picked)
    group = F.max(F.when(~own, group_state(hazard_state(F.col("storm"), F.col("hail"))))).alias("_group")
    out = each.groupBy(*keys).agg(*picked, group)
    return out.withColumn("state", F.coalesce("_group", hazard_state(F.col("storm"), F.col("hail")))).drop("_group")


def families(cells: DataFrame, keys: list[str], level: str = "lod") -> DataFrame:
    """keys, parent_(channels), parent_state, child (0 to 3), rain, storm, hail and state of the four children of cells (as in sample(), of levels above 0).

    Everything is evaluated once: a cell's state rolls up from its children's
    values, which the children show themselves, and theirs from their own
    children. All places are made from the cell's row, so the three aggregates
    run within the partition that made the cell, and no child is joined with its
    parent.
    """
    depth, span = F.col(level), F.pow(F.lit(2.0), F.col(level)) / P.BASE_GRID
    # The cell itself is child -1, a child itself grandchild -1; child k lies right of the middle if k is odd, below it from 2 on.
    right = lambda k, by: F.when(F.col(k) < 0, 0.0).otherwise((F.col(k) % 2 * 2 - 1) * by)
    down = lambda k, by: F.when(F.col(k) < 0, 0.0).otherwise((F.floor(F.col(k) / 2) * 2 - 1) * by)
    few = F.array(F.lit(-1))
    probed = cells.withColumn("_child", F.explode(F.sequence(F.lit(-1), F.lit(3))))
    probed = probed.withColumn("_grand", F.explode(F.when((F.col("_child") >= 0) & (depth > 1), F.sequence(F.lit(-1), F.lit(3))).otherwise(few)))
    # Level 0 is evaluated at a point, others at nine places over the cell.
    reach = F.when(F.col("_child") < 0, span).when(F.col("_grand") < 0, F.when(depth > 1, span / 2)).when(depth > 2, span / 4)
    probed = probed.withColumn("_reach", F.coalesce(reach, F.lit(0.0)))
    probed = probed.withColumn("_o", F.explode(F.when(F.col("_reach") > 0, F.sequence(F.lit(0), F.lit(8))).otherwise(F.array(F.lit(4)))))
    ox, oy = OFFSETS[2] * (F.col("_o") % 3 - 1), OFFSETS[2] * (F.floor(F.col("_o") / 3) - 1)
    probed = probed.withColumns(
        {"_x": F.col("x") + right("_child", span * 0.25) + (right("_grand", span * 0.125) + ox * F.col("_reach")), "_y": F.col("y") + down("_child", span * 0.25) + (down("_grand", span * 0.125) + oy * F.col("_reach"))}
    )
    valued = with_field(probed, "_x", "_y").select(*keys, "_child", "_grand", *P.CHANNELS)
    each = valued.groupBy(*keys, "_child", "_grand").agg(
        F.avg("rain").alias("rain"), mix(F.avg("storm"), F.max("storm"), 0.58).alias("storm"), mix(F.avg("hail"), F.max("hail"), 0.72).alias("hail")
    )
    own, point = F.col("_grand") < 0, hazard_state(F.col("storm"), F.col("hail"))
    kids = each.groupBy(*keys, "_child").agg(*[F.max(F.when(own, F.col(c))).alias(c) for c in P.CHANNELS], F.max(F.when(~own, group_state(point))).alias("_group"))
    shown = F.struct(F.col("_child").alias("child"), *P.CHANNELS, F.coalesce("_group", point).alias("state"))
    parent = F.col("_child") < 0
    out = kids.groupBy(*keys).agg(*[F.max(F.when(parent, F.col(c))).alias(f"parent_{c}") for c in P.CHANNELS], F.max(F.when(~parent, group_state(point))).alias("parent_state"), F.collect_list(F.when(~parent, shown)).alias("_kids"))
    return out.select(*keys, *[f"parent_{c}" for c in (*P.CHANNELS, "state")], F.inline("_kids"))
