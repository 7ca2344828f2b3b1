"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations that take a minimum (combined before the shuffle, so a node with
very many neighbours is no hot task) and one join each. Nothing is collected but a count and a
checksum a round, which tell whether the edges still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v): link each node's neighbours (larger or not larger ones) to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its least node."""
    edges = common.checkpointed(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct())
    state = None
    while True:
        edges = common.checkpointed(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return named.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = now
