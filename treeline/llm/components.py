"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed; every round is a minimum by node (combined map-side) and a join back, so a
node of very many neighbours is split like any skewed join.  Each round is checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pointed(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> rows (node, root) of all nodes with an edge to another; root is the smallest."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    while True:
        # Large star: every larger neighbour of u points to the smallest node around u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _pointed(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours point to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _pointed(large, least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = small.filter("u <> v").distinct().checkpoint()
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = now
