"""Coverage: histograms, quantile thresholds, and remapping that keeps the covered area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import clamp


def bin_of(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(P.BINS - 1), F.floor(clamp(v) * P.BINS))).cast("int")


def long_form(grid: DataFrame, channels=P.CHANNELS) -> DataFrame:
    """(frame_id, channel, value)."""
    return grid.select("frame_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in channels])).alias("e")).select("frame_id", "e.*")


def histogram(values: DataFrame) -> DataFrame:
    """(frame_id, channel, bin, n)."""
    return values.groupBy("frame_id", "channel", bin_of(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))


def coverage_counts(values: DataFrame, bands: DataFrame) -> DataFrame:
    """(frame_id, channel, band, covered): cells at or above each band's threshold. bands is the constant table of bands."""
    return values.join(F.broadcast(bands), "channel").groupBy("frame_id", "channel", "band", "threshold").agg(F.count_if(F.col("value") >= F.col("threshold")).alias("covered"))


def thresholds(hist: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (frame_id, channel, band, covered) with the value above which that many cells lie, within a bin.

    Bins are added up from the top; the first that reaches the target is divided in proportion.
    """
    down = Window.partitionBy("frame_id", "channel").orderBy(F.desc("bin"))
    upto = hist.withColumn("cum", F.sum("n").over(down))
    met = upto.join(targets, ["frame_id", "channel"]).where(F.col("cum") >= F.col("covered"))
    # The first bin from the top is the highest one that reaches the target.
    first = met.groupBy("frame_id", "channel", "band").agg(F.max_by(F.struct("bin", "n", "cum"), "bin").alias("b"))
    out = targets.join(first, ["frame_id", "channel", "band"], "left")
    before = F.col("b.cum") - F.col("b.n")
    inside = (F.col("b.bin") + 1 - (F.col("covered") - before) / F.col("b.n")) / P.BINS
    return out.withColumn("value", F.when(F.col("covered") <= 0, 1.0).otherwise(F.coalesce(inside, F.lit(0.0)))).drop("b")


def rising(rain: DataFrame) -> DataFrame:
    """The rain bands' thresholds, each at least 1e-5 above the one below and rounded to 32 bits; one row a band.

    A fold over the five bands of a frame, unrolled as columns.
    """
    wide = rain.groupBy("frame_id").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"v{b}") for b in range(5)])
    low = F.lit(0.0)
    for b in range(5):
        wide = wide.withColumn(f"e{b}", F.greatest(low, F.least(F.lit(1.0 - (4 - b) * 1e-5), F.col(f"v{b}"))).cast("float").cast("double"))
        low = F.col(f"e{b}") + 1e-5
    return wide.select("frame_id", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"e{b}").alias("threshold")) for b in range(5)])).alias("e")).select("frame_id", F.lit("rain").alias("channel"), "e.*")


def remap(original: DataFrame, smooth: DataFrame, bands: DataFrame) -> DataFrame:
    """(frame_id, channel, band, threshold) under which the smoothed grid covers what the original did."""
    targets = coverage_counts(long_form(original), bands).select("frame_id", "channel", "band", "covered")
    found = thresholds(histogram(long_form(smooth)), targets)
    others = found.where("channel <> 'rain'").select("frame_id", "channel", "band", F.col("value").alias("threshold"))
    return rising(found.where("channel = 'rain'")).unionByName(others)


def within_view(grid: DataFrame) -> DataFrame:
    """The cells of a grid (with start_i, start_j and the bounds low_x, high_x, low_y, high_y) whose centres lie within the bounds."""
    step = 1.0 / P.BASE_GRID
    inside = lambda k, low, high: (k >= F.ceil(F.col(low) / step - 0.5)) & (k <= F.floor(F.col(high) / step - 0.5))
    return grid.where(inside(F.col("col") + F.col("start_i"), "low_x", "high_x") & inside(F.col("row") + F.col("start_j"), "low_y", "high_y"))
