"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected links `(a, b)`.

    `component` is the smallest node reachable. Each step joins links with one minimum per node,
    so no node's links are gathered in one place; minima are partly aggregated before they are
    shuffled, and Spark splits the partition of a hub in the join. Links with a null end, loops
    and repeated links are harmless; no links give no rows.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while (state := edges.select(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()) != before:
        before = state
        edges = materialize(_small_star(_large_star(edges)), "links")
    # now every edge points from a node to the smallest of its component
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets linked to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours get linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(smallest, "a").where("b <> m").select("b", "m")
    return moved.union(smallest).toDF("a", "b").distinct()
