"""Scalar functions of columns: arithmetic, transfer functions, colours, opacities."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(v, low=0.0, high=1.0) -> Column:
    """The low end wins where the ends are crossed."""
    return F.greatest(lit(low), F.least(lit(high), lit(v)))


def mix(a, b, t) -> Column:
    return lit(a) + (lit(b) - lit(a)) * lit(t)


def smoothstep(a, b, x) -> Column:
    t = clamp((lit(x) - lit(a)) / (lit(b) - lit(a)))
    return t * t * (3.0 - 2.0 * t)


def nearest(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + 0.5)


def pulse(t: Column, phase: float) -> Column:
    return 0.5 + 0.5 * F.sin((t + phase) * (2 * pi))


def strength(v: Column, channel: str) -> Column:
    return smoothstep(P.FLOOR[channel] * 0.45, 0.93, v)


def power(x: Column, exponent: float) -> Column:
    """x to an exponent; nothing stays nothing."""
    return F.pow(x, F.lit(exponent))


def hazard_state(storm: Column, hail: Column) -> Column:
    """0 none, 1 to 3 storm, 4 to 6 hail; hail comes first."""
    grade = lambda s: F.greatest(F.lit(1), F.ceil(s * 3).cast("int"))
    s, h = strength(storm, "storm"), strength(hail, "hail")
    return F.when(h > 0, 3 + grade(h)).when(s > 0, grade(s)).otherwise(F.lit(0))


def group_state(child_state: Column) -> Column:
    """What one child adds to its group's state; the group has the largest."""
    return F.when(child_state > 3, 4).when(child_state > 0, 1).otherwise(0)


def radius(v: Column, spacing, channel: str) -> Column:
    return lit(spacing) * P.OVERLAP[channel] * power(strength(v, channel), P.EXPONENT[channel])


def strong_rain(rain: Column) -> Column:
    return clamp((rain - P.MODERATE_MAX) / (1 - P.MODERATE_MAX))


def hazard_radius(storm: Column, hail: Column, state: Column, spacing) -> Column:
    of = lambda v, channel, low, high: lit(spacing) * mix(low, high, power(strength(v, channel), 0.47))
    return F.when(state <= 0, 0.0).when(state <= 3, of(storm, "storm", 0.30, 0.72)).otherwise(of(hail, "hail", 0.34, 1.0))


def hazard_kind(state: Column) -> Column:
    return F.when(state > 3, "hail").otherwise("storm")


def hazard_hex(state: Column) -> Column:
    return F.when(state > 3, P.HAIL_HEX).otherwise(P.STORM_HEX)


def symbol_vertices(x: Column, y: Column, r: Column, kind: Column) -> Column:
    """Vertices of a symbol: a hexagon for hail, a four-pointed star for storm."""
    vertex = lambda n, inner: lambda k: F.struct(
        k.alias("point"),
        (x + F.cos(k * (2 * pi / n) - pi / 2) * inner(k)).alias("px"),
        (y + F.sin(k * (2 * pi / n) - pi / 2) * inner(k)).alias("py"),
    )
    hexagon = F.transform(F.sequence(F.lit(0), F.lit(5)), vertex(6, lambda k: r))
    star = F.transform(F.sequence(F.lit(0), F.lit(7)), vertex(8, lambda k: F.when(k % 2 == 0, r).otherwise(r * 0.38)))
    return F.when(kind == "hail", hexagon).otherwise(star)


def hex_to_rgb(code: Column) -> Column:
    part = lambda k: F.conv(F.substring(code, k, 2), 16, 10).cast("int")
    return F.array(part(2), part(4), part(6))


def rgb(colour) -> list[Column]:
    return [lit(c) for c in colour]


def mix_colour(a, b, amount) -> list[Column]:
    """Each channel rounded, with the amount clamped."""
    t = clamp(amount)
    return [nearest(mix(p, q, t)).cast("double") for p, q in zip(a, b, strict=True)]


def colour_string(colour) -> Column:
    return F.format_string("rgb(%d %d %d)", *[c.cast("int") for c in colour])


def rain_colour(rain: Column, spacing) -> list[Column]:
    r = radius(rain, spacing, "rain")
    full = radius(F.lit(P.MODERATE_MAX), spacing, "rain")
    bright = mix_colour(rgb(P.BACKGROUND), rgb(P.RAIN_RGB), clamp((r - 0.4) / (full - 0.4)))
    base = [F.when(r <= 0.4, float(bg)).otherwise(c) for bg, c in zip(P.BACKGROUND, bright, strict=True)]
    strong = strong_rain(rain)
    overlaid = mix_colour(base, rgb(P.STRONG_RGB), power(strength(strong, "rain"), 0.47))
    return [F.when(radius(strong, spacing, "rain") > 0, o).otherwise(b) for o, b in zip(overlaid, base, strict=True)]


def over_storm(colour, storm: Column, state: Column) -> list[Column]:
    s = power(strength(storm, "storm"), 0.47)
    shown = ((state > 0) & (state <= 3)) | ((state > 3) & (s > 0))
    return [F.when(shown, o).otherwise(c) for o, c in zip(mix_colour(colour, rgb(P.STORM_RGB), mix(0.45, 1, s)), colour, strict=True)]


def over_hail(colour, hail: Column, state: Column) -> list[Column]:
    h = power(strength(hail, "hail"), 0.47)
    return [F.when(state > 3, o).otherwise(c) for o, c in zip(mix_colour(colour, rgb(P.HAIL_RGB), mix(0.5, 1, h)), colour, strict=True)]


def square_drawn(rain: Column, state: Column, spacing) -> Column:
    """Whether a cell is drawn: not where nothing covers the background."""
    return (radius(rain, spacing, "rain") > 0) | (state > 0)


def field_opacity(v: Column, onset: float, core: float, exponent: float) -> Column:
    return power(smoothstep(onset, core, v), exponent)


def hazard_opacity(v: Column, onset: float, visible: float, strong: float, core: float, tail: float = 0.68) -> Column:
    return (
        F.when(v < visible, 0.4 * power(smoothstep(onset, visible, v), tail))
        .when(v < strong, mix(0.4, 0.65, smoothstep(visible, strong, v)))
        .otherwise(mix(0.65, 1.0, smoothstep(strong, core, v)))
    )


def composite(colour, opacity: Column, pixel) -> list[Column]:
    """Source-over of a colour on a pixel (r, g, b, a), not premultiplied."""
    r, g, b, a = pixel
    alpha = opacity + a * (1.0 - opacity)
    safe = F.when(opacity > 0, alpha).otherwise(1.0)
    mixed = [(lit(c) * opacity + p * a * (1.0 - opacity)) / safe for c, p in zip(colour, (r, g, b), strict=True)]
    return [F.when(opacity > 0, m).otherwise(p) for m, p in zip([*mixed, alpha], pixel, strict=True)]


def spline_weights(t: Column) -> list[Column]:
    """The four weights of the approximating cubic B-spline."""
    u = 1.0 - t
    return [u * u * u / 6.0, (3.0 * t * t * t - 6.0 * t * t + 4.0) / 6.0, (-3.0 * t * t * t + 3.0 * t * t + 3.0 * t + 1.0) / 6.0, t * t * t / 6.0]


def half(i: Column) -> Column:
    """Floor of half an index, also below zero."""
    return F.floor(i / 2).cast("long")


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)
