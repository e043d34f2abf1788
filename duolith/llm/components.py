"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each node of an edge is linked to. Edges without links to others may be left out.

    Each step hangs every node on a smaller neighbour of its neighbourhood: rows stay as many as the edges, a node with
    many neighbours is met by an aggregate and a join that can be split, and the number of steps grows with the logarithm
    of the size of a component. Each step is written to the checkpoint folder.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    n = now.count()
    while True:
        # large star: of both ends, hang all larger neighbours on the smallest of the neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: hang the smaller neighbours and the node itself on the smallest
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct())
        m = after.count()
        done = m == n and not after.join(now, ["u", "v"], "left_anti").head(1)  # distinct on both sides: the same edges
        now, n = after, m
        if done:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
