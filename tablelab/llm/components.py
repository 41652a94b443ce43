"""Connected components of a table of links, as a few joins and aggregates per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.session import checkpointed


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached, for every node with a link to another one.

    Alternating star contraction: each node hands its neighbours above it, then those below it, to the smallest node
    around it, until nothing changes. A node's neighbours are only ever aggregated to their smallest and joined back,
    never gathered, and every round is written, so that plans stay short and lost executors are made good.
    """
    links = checkpointed(links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = None
    while True:
        # Large star: every larger neighbour, and the node itself, points at the smallest of the neighbourhood.
        both = _both_ways(links)
        least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = checkpointed(both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: the smaller neighbours, and the node itself, point at the smallest of them.
        least = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = checkpointed(small.filter(F.col("a") != F.col("b")).distinct())
        now = after.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if size == tuple(now):
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        links, size = after, tuple(now)
