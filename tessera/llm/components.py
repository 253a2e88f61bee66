"""Connected components by contraction: each round every node joins a neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _rank(node: str) -> Column:
    """Nodes in a random but fixed order, so that long chains shrink by a share each round."""
    return F.struct(F.xxhash64(node).alias("hash"), F.col(node).alias("node"))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a bigint, b bigint); root is the least node of the component.

    A round maps every node to the first, in a random order, of itself and its neighbours, and
    both ends of every link likewise; links whose ends meet disappear. The number of rounds grows
    with the logarithm of the longest chain. All steps are aggregations and joins by node with
    map-side combination; nothing is gathered. Nulls link with nothing; loops are left out.
    """
    edges = checkpoint(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct())
    label = None
    while label is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(_rank("b")).alias("first"))
        step = checkpoint(step.select(F.col("a").alias("node"), F.least(F.col("first"), _rank("a"))["node"].alias("to")))
        if label is None:
            label = step.select("node", F.col("to").alias("root"))
        else:
            label = checkpoint(label.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        left = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        moved = left.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = checkpoint(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    least = label.groupBy("root").agg(F.min("node").alias("least"))
    return checkpoint(label.join(least, "root").select("node", F.col("least").alias("root")))
