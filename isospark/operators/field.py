"""The field: rain, storm and hail at (x, y, t, travel_x), as a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import clamp, lit, mix, pulse, smoothstep, total

HOISTED = ["_life"] + [f"_{p}{n}" for n in range(len(P.COMPONENTS)) for p in ("xx", "xy", "yy", "amp")]


def _run(value, waves) -> Column:
    return mix(value[0], value[1], waves[value[2]]) if isinstance(value, tuple) else lit(value)


def with_time(df: DataFrame, t: str = "t") -> DataFrame:
    """Adds what depends on t alone. On a small table of frames this is done once a frame, before any cell is made."""
    time = F.col(t)
    df = df.withColumns({f"_w{k}": pulse(time, phase) for k, phase in P.PHASES.items()} | {"_life": smoothstep(0.0, 0.12, time) * smoothstep(0.0, 0.12, 1.0 - time)})
    waves = {k: F.col(f"_w{k}") for k in P.PHASES}
    turned, made = {}, {}
    for n, (_, _, _, _, sx, sy, rotation, amplitude) in enumerate(P.COMPONENTS):
        turn, wx, wy = _run(rotation, waves), _run(sx, waves), _run(sy, waves)
        turned |= {f"_c{n}": F.cos(turn), f"_s{n}": F.sin(turn), f"_px{n}": 1.0 / (wx * wx), f"_py{n}": 1.0 / (wy * wy), f"_amp{n}": _run(amplitude, waves)}
        c, s, px, py = (F.col(f"_{k}{n}") for k in ("c", "s", "px", "py"))
        made |= {f"_xx{n}": -0.5 * (c * c * px + s * s * py), f"_xy{n}": c * s * (py - px), f"_yy{n}": -0.5 * (s * s * px + c * c * py)}
    df = df.withColumns(turned).withColumns(made)
    return df.drop(*[f"_w{k}" for k in P.PHASES], *[f"_{k}{n}" for n in range(len(P.COMPONENTS)) for k in ("c", "s", "px", "py")])


def gaussian(dx: Column, dy: Column, n: int) -> Column:
    """A turned Gaussian by the quadratic form that with_time() has made of its widths and rotation."""
    return F.exp((F.col(f"_xx{n}") * dx + F.col(f"_xy{n}") * dy) * dx + F.col(f"_yy{n}") * dy * dy)


def with_field(df: DataFrame, x: str = "x", y: str = "y", travel_x: str = "travel_x", names=P.CHANNELS) -> DataFrame:
    """Adds the three channels to rows that with_time() has prepared, and drops what it added."""
    local, cy = F.col(x) - F.col(travel_x), F.col(y)
    sums = {c: [] for c in P.CHANNELS}
    for n, (channel, sign, offset, centre, *_) in enumerate(P.COMPONENTS):
        g = gaussian(F.col(x) - (F.col(travel_x) + offset), cy - centre, n) * F.col(f"_amp{n}")
        sums[channel].append(g if sign > 0 else -g)
    detail = {
        "rain": 0.91 + 0.045 * F.sin(local * 47.0 + F.sin(cy * 31.0)) + 0.035 * F.sin(cy * 59.0 - local * 17.0),
        "storm": 0.96 + 0.045 * F.sin(local * 41.0 + cy * 33.0),
        "hail": 0.97 + 0.035 * F.sin(local * 53.0 - cy * 47.0),
    }
    outside = (F.abs(local) > P.SUPPORT_X) | (F.abs(cy - 0.5) > P.SUPPORT_Y)
    out = {name: F.when(outside, 0.0).otherwise(clamp(total(sums[c]) * detail[c] * F.col("_life"))) for name, c in zip(names, P.CHANNELS, strict=True)}
    return df.withColumns(out).drop(*HOISTED)


def evaluate(points: DataFrame, t: str = "t") -> DataFrame:
    """Points (x, y, t, travel_x and other columns) with the three channels."""
    return with_field(with_time(points, t))
