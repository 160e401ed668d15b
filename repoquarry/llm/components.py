"""Connected components of a stored graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.sources.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b) that has a neighbour; the component is its smallest node.

    Each round links the larger neighbours of every node to its smallest one, then the smaller ones,
    until nothing changes; rounds grow with the logarithm of a component's size. All steps are joins
    and partial aggregates, so a hub may have any number of neighbours, and each round is stored, so a
    lost executor costs one round at most. Loops, repeated edges and both directions are allowed.
    """
    found = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = materialize(found, "edges")
    state = _state(found)
    while state[0]:
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        found = materialize(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        last, state = state, _state(found)
        if state == last:
            break
    nodes = found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes."""
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).head())
