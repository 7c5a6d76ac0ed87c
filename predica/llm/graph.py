"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (a, b) with a > b.

    The least neighbour of each node comes from a partial aggregation and is joined back, so the rows of a hub are never
    together in one task.
    """
    pairs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = pairs.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("m"))
    linked = pairs.join(least, "a")
    if large:  # as many rows as edges, of which the small step leaves no repeated ones
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges are stars: each node has one edge to a lesser one, or none and is the least of its star."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge; root is the least node that it reaches.

    Alternating large-star and small-star steps until all are stars; the work of a round is linear in the edges, the number of
    rounds grows with the logarithm of the longest chain. Each round is checkpointed. Ids are bigints; loops, repeated edges
    and nulls add nothing; no edges give an empty result. A result's edges (node, root) stand for what led to it, so with
    further edges they take fewer rounds.

    Each shuffle and broadcast leaves a thread on the driver for a minute, so rounds and shuffles cost its memory.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    while True:
        now = checkpointed(_star(_star(now, True), False))
        if _settled(now):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
