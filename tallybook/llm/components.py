"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, v, low): each edge with the lowest node that is ``u`` or next to it."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    return edges.join(low, "u").withColumn("low", F.least("low", "u"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the lowest node reachable from every node of ``edges`` (a, b), both of any integer or string type.

    Each round links larger neighbours to a node's lowest neighbour, then smaller ones, until every node hangs on its
    root alone; rounds grow with the logarithm of the longest path. Hubs are met by partial aggregation and by joins
    that the adaptive skew join can split. Rounds are stored in the shared folder; only a count and a checksum come back.
    """
    stars = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
        seen = mark
        both = stars.union(stars.select("v", "u"))
        large = _lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        small = _lowest(large)
        stars = small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(small.select("u", "low")).filter("u <> v").distinct()
        stars = stored(stars, "edges")
