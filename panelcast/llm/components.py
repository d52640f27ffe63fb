"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.sources.scratch import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    ways = _both_ways(edges)
    least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return ways.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    to_least = edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
    own = least.select(F.col("m").alias("u"), "v")
    return to_least.unionByName(own)


def component_roots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for the nodes of edges ``(u, v)`` that are not the smallest reachable.

    Each round is written before the next one reads it; only a row count and a checksum reach the
    driver. Rounds grow with the logarithm of the longest chain. Loops and repeated edges do no
    harm; without edges there are no rows.
    """

    def ordered(frame: DataFrame) -> DataFrame:
        return (
            frame.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            .filter("u < v")
            .distinct()
        )

    def state(frame: DataFrame) -> tuple:
        mark = F.xxhash64("u", "v").bitwiseAND(F.lit(0x7FFFFFFF))
        return tuple(frame.agg(F.count("*"), F.sum(mark.cast("decimal(38,0)"))).first())

    current = scratch.save(ordered(edges), "edges")
    before = state(current)
    while True:
        current = scratch.save(ordered(_small_star(ordered(_large_star(current)))), "stars")
        after = state(current)
        if after == before:
            return current.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = after
