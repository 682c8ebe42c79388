"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import observed

#: Edges below which a round's minima are sent to all tasks (16 bytes a node) instead of shuffling the edges to them.
BROADCAST_EDGES = 50_000


def components(links: DataFrame) -> DataFrame:
    """(id, component): every linked id that isn't its component's smallest, with the smallest.

    ``links`` has columns a and b. Each round is two aggregates and two joins, checkpointed; a
    node with very many links is aggregated before the shuffle and its join is split by AQE.
    The rounds end when only stars are left, which takes one aggregate to see.
    """
    edges, seen = observed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while not _stars(edges):
        few = seen["n"] <= BROADCAST_EDGES
        near = F.broadcast if few else lambda df: df
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(near(lowest), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large if few else large.distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near(below), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(below.select("a", F.col("m").alias("b")))
        edges, seen = observed(small.where("a != b").distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a: then each b is the smallest of its component, as b < a."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("low")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("low")))
    # a node without lower neighbours has k = 0, a leaf has k = n = 1
    nodes = ends.groupBy("u").agg(F.sum("low").alias("k"), F.count(F.lit(1)).alias("n"))
    return not nodes.where("k > 0 and n > 1").agg(F.count(F.lit(1)).alias("n")).first()["n"]
