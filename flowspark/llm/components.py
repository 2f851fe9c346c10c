"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)``, the least node that ``edges`` (``u``, ``v``; longs) reach, for every node with an edge to another.

    Each round is two joins on aggregated minima, so a node with very many
    neighbours is spread by partial aggregation and skew joins; rounds grow
    with the logarithm of the longest path.
    """
    now = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour goes to the least one.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "c"))
        large = both.join(least, F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("c"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        now = settle(small.filter("u <> v").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if state[0] == state[2] and tuple(state) == before:  # each node has one edge, and nothing moved
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = tuple(state)
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
