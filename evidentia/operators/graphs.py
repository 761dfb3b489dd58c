"""Connected components by alternating star contraction, with staged rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.staging import stage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")), "least").withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v): root is the smallest node it can reach. Nodes are of any type with an order.

    The smallest neighbours are staged before they are joined back, so that both
    sides of the join are plain exchanges that Spark can split where a node has
    very many neighbours. Rounds grow with the logarithm of the longest chain.
    """
    edges = stage(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = _signature(edges)
    while True:
        large = stage(_large_star(edges).distinct(), "edges")
        edges = stage(_small_star(large).distinct(), "edges")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
