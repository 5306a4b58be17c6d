"""Connected components over an edge table, by alternating stars.

Each round joins every node's neighbours to the smallest of them (large star:
the larger neighbours; small star: the smaller ones), which halves distances at
least, until all edges lead to the component's smallest node. Nothing is
gathered per node: minima are pre-aggregated sums, and the join back is salted
by the neighbour, so a node with a third of all edges is spread over tasks. Each
round is written to the shared folder; one row of counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Parts into which the edges of one node are spread in a join.
SALTS = 16


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest of u and all of u's v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    # Sizes of exploded rows are underestimated; the hint keeps them from being broadcast.
    spread = least.select("u", "m", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread.hint("merge"), ["u", "salt"]).select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _to_smallest(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    stars = _to_smallest(large)
    return stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(stars.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, component) of every node of edges (u long, v long), component the smallest node.

    Loops and repeated edges are allowed, null ends are ignored; no edges give no rows.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or (state.n, state.h) == seen:
            break
        seen = (state.n, state.h)
        after = cut(_round(now), label)
        drop_cut(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
