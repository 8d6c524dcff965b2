"""Connected components of links, by alternating stars.

Every round lets each node hand its larger neighbours (large star) and then its smaller
ones (small star) to the smallest node near it. The links become stars around the smallest
node of each component. A round is two aggregations and two joins on the node; minima are
taken before the shuffle, and rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    smallest = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    return both.where("y > x").join(smallest, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    smallest = down.groupBy("x").agg(F.min("y").alias("m"))
    joined = down.join(smallest, "x")
    return joined.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(
        smallest.select("x", F.col("m").alias("y"))
    ).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(x, y)``; the component is its smallest node.

    Links are taken in both directions, may repeat and may link a node to itself. Nodes
    without links are not returned. Nulls are no nodes. The two numbers that tell whether a
    round changed anything are all that reaches the driver.
    """
    edges = written(edges.select("x", "y").where("x is not null and y is not null and x <> y").distinct(), "links")
    seen = None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(x, y))")).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        edges = written(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).union(
        edges.select(F.col("y").alias("node"), F.col("y").alias("component"))).distinct()
