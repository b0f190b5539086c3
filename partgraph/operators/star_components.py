"""Connected components of an edge table by alternating large-star and small-star steps.

The published algorithm (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): every step replaces the neighbours of a vertex by links to its
smallest one, so that the number of links never grows and a component becomes a
star around its smallest vertex after a few steps, also along long chains.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partgraph.plans.joins import skew_join


def star_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], most: int = 64) -> DataFrame:
    """(node, root) for every vertex that is not the smallest of its component.

    ``edges`` has columns a and b of one orderable type; direction, repeats and
    self-loops don't matter. ``cut`` truncates lineage (a checkpoint); where rounds are
    many it should count sizes too (``measured_cut``). Minima are
    aggregated before they are joined back, so a vertex with very many links is
    split by the skew join rather than gathered. No edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    e = cut(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    for _ in range(most):
        both = e.unionByName(e.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min(F.least(a, b)).alias("m"))
        big = skew_join(both, least, ["a"]).where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = skew_join(big, least, ["a"]).select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        e = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            return e.select(a.alias("node"), b.alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")
