"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the smallest node that it can reach.

    Alternating large-star and small-star rounds: each node's smallest neighbour comes from an aggregate with map-side combine, and
    the edges are then linked to it in an equi-join, which adaptive execution splits where a hub is hot. Every round is written
    to the shared folder and the one before it removed. Rounds grow with the logarithm of the longest chain.
    """
    now = stored(_both(edges).where("u > v").distinct(), "edges")
    for _ in range(max_rounds):
        large = _star(_both_ways(now), "v > u")
        small = _star(large, None)
        after = stored(small, "edges")
        # Stars only: no node that is someone's centre has a smaller neighbour of its own.
        chained = after.select(F.col("v").alias("u")).distinct().join(after.select("u").distinct(), "u", "left_semi")
        done = chained.isEmpty()
        drop(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, larger: str | None) -> DataFrame:
    """Link each node's (larger, or all) neighbours and itself to the smallest of them. Result: u > v, distinct."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = edges.join(least, "u")
    if larger:
        out = linked.where(larger).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()
