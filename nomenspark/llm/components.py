"""Connected components by alternating large-star and small-star steps on DataFrames.

Each step aggregates the least neighbour of a node (partially before the shuffle) and joins it back; after a pair of
steps the edges are written to the shared folder, so a lost executor repeats one step at most. Nothing is collected but
two sums that tell whether an edge has changed. A hub's edges are one skewed join key, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the least of each node u and its neighbours v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of the edges but the roots; root is the least id reachable."""
    now = scratch.table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        later = scratch.table(small_star(large_star(now)), "edges")
        scratch.drop(now)
        now, before, state = later, state, _state(later)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
