"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def star_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node but the roots; the root is the smallest node of the component.

    Minima are taken by map-side aggregates and joined back, so no node's neighbours are ever collected; hot
    nodes are split by AQE's skew join. Each round is written to the checkpoint folder. Rounds go on until one
    changes nothing; their number grows as the square of the logarithm of the longest path. Nodes are compared
    as longs.
    """
    a_, b_ = F.col(a), F.col(b)
    now = durable(edges.where(a_ != b_).select(F.greatest(a_, b_).alias("u"), F.least(a_, b_).alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.where(F.col("u") != F.col("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        now = durable(small.distinct())
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
