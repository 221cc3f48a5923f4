"""Connected components of edge tables by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    Edges with a null end and loops count for nothing. Every step is an aggregate (min by node) or a join
    of two written tables, so a node with very many edges is pre-aggregated or split, never gathered.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = scratch.written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = scratch.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "large")
        large = scratch.written(
            both.where("b > a").join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "large-star",
        )
        least = scratch.written(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        after = scratch.written(small.distinct(), "small-star")
        ends = after.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            after.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        open_ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where(
            "up > 1 or (up = 1 and down > 0)"
        )
        done = open_ends.isEmpty()
        scratch.drop(now, lowest, large, least)
        now = after
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
    raise RuntimeError(f"components are still open after {most_rounds} rounds")
