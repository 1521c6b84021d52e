"""Connected components of a link table by alternating large-star and small-star steps, all of it in distributed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node it reaches) of every node of ``links`` (a, b).

    Each step sends every node's neighbours to their smallest one; the number of steps grows with the logarithm of the
    longest chain. A node of very many links is pre-aggregated to its smallest neighbour, and its rows meet that one value in a join
    whose large partitions Spark splits.
    """
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = scratch.save(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(edges)
        before, edges, state = state, after, _state(after)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
