"""Connected components by contraction: a distributed union-find in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) of one type -> (node, component) for all nodes with an edge to another; component: its smallest node.

    Each round points every node at its smallest neighbour if that is smaller than itself, and replaces both ends of
    each edge by where they point. In each component at least every second node goes, so rounds are logarithmic.
    Neighbours are only ever reduced to their minimum, never gathered. Null ends and loops are dropped.
    """
    left = staged(edges.filter("a <> b").select(*_ordered(F.col("a"), F.col("b"))).distinct(), "edges")
    labels = None
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = staged(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")), "parents")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            moved = labels.join(parents.select(F.col("node").alias("component"), "parent"), "component", "left")
            labels = staged(moved.select("node", F.coalesce("parent", "component").alias("component")), "labels")
        pa, pb = (parents.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in "ab")
        after = staged(left.join(pa, "a").join(pb, "b").filter("pa <> pb").select(*_ordered(F.col("pa"), F.col("pb"))).distinct(), "edges")
        unstage(left)
        left = after
        if left.isEmpty():
            return labels
