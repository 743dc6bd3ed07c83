"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.work import dropped, written


def _lowest(edges: DataFrame) -> DataFrame:
    # Stored, so that the join with it deals both sides anew and a hub with many edges can be split.
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one edge and no ``v`` has any of its own."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    found = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return found.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked with; a node that is the smallest itself is
    left out.

    ``edges`` has two long columns ``u`` and ``v``; repeated edges, both directions and loops are fine.
    Every round replaces the edges by stars around smaller nodes and stores them; the number of rounds grows with
    the logarithm of the longest chain.  A node is never gathered with all its neighbours: minima are taken
    by partial sums, and joins may be split.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = written(e.where("u <> v").distinct(), "edges")
    while not _are_stars(e):
        last = e
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both)
        large = both.join(low, "u").where("v > u")
        large = large.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = written(large, "large-star")
        lower = _lowest(large)
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), "m")
        small = small.union(lower).toDF("u", "v").distinct()
        e = written(small, "small-star")
        for old in (last, low, large, lower):
            dropped(old)
    return e.toDF("node", "component")
