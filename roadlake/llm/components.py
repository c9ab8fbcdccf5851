"""Connected components of a large graph, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm.shared import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node itself are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = down.join(least, "u")
    return kept.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the least node of its group.

    ``edges`` has (u, v), orderable and never null; loops and repeats are allowed. Each round is written to the shared
    folder. The rounds end when every edge goes from a node of no other edge to a node without a smaller neighbour, as
    in a star; that takes about log(nodes) of them.
    """
    stars = scratch.cut(edges.where("u != v").select("u", "v").distinct())
    for _ in range(rounds):
        large = _large_star(stars).distinct()
        nxt = scratch.cut(_small_star(large).where("u != v").distinct())
        scratch.drop(stars)
        stars = nxt
        ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(stars.select("v", F.lit(0)))  # u > v in every edge
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 or (up = 1 and n > 1)").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
