"""Connected components of a large edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _stars(edges: DataFrame, whole: bool) -> DataFrame:
    """Links the neighbours of each node to its smallest one; `whole` takes all neighbours and moves the larger
    ones, else the smaller neighbours and the node itself are moved. Minima come from partial sums and a join, so
    a node with very many neighbours is no single task."""
    both = edges.select("a", "b")
    around = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))) if whole else both
    least = around.groupBy("a").agg(F.min("b").alias("low"))
    joined = around.join(least, "a")
    if whole:
        moved = joined.select(F.col("b"), F.least("low", "a").alias("low")).filter("b > low")
        # the node itself stays linked with its smallest neighbour
        moved = moved.unionByName(least.select(F.col("a").alias("b"), "low").filter("b > low"))
    else:
        moved = joined.select("b", "low").unionByName(least.select(F.col("a").alias("b"), "low")).filter("b > low")
    return moved.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that can be reached.

    Each step is a staged table; the number of steps grows with the logarithm of the longest path. Loops and
    repeated edges are allowed, an empty table gives an empty result.
    """
    now = stage(edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                       F.count_distinct("a")).first()
        if not sign[0] or tuple(sign) == before:
            break
        before = tuple(sign)
        now = stage(_stars(_stars(now, True), False))
    found = now.groupBy("a").agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().join(found.select(F.col("a").alias("node")), "node", "left_anti")
    return found.withColumnRenamed("a", "node").unionByName(roots.select("node", F.col("node").alias("component")))
