"""Connected components of a distributed edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round links every larger neighbour of a node to the smallest neighbour (large star), then
    every node and its smaller neighbours to the smallest of them (small star). Minima are combined
    before the shuffle, no group is collected, and AQE splits the join of a hot node. Every round
    ends in a checkpoint. Nodes without an edge don't come back. Null ends and loops are ignored.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = _sum(e)
    while seen[0]:  # about as many rounds as the longest chain has bits; each makes links shorter or ends
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = cut(small.where("a > b").distinct())
        now = _sum(e)
        if now == seen:
            break
        seen = now
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
