"""Neighbourhoods: edges between places, cohesion of a support, connected components, hop distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.settle import settled


def cohesion(edges: DataFrame, inside: DataFrame, rid: str = "rid") -> DataFrame:
    """n_inner, n_outer, cohesion: of the edges (a, b) with an end in the support (rid), the share with both."""
    s = inside.select(F.col(rid).alias("_s")).distinct()
    marked = edges.join(s.withColumn("in_a", F.lit(1)), edges.a == F.col("_s"), "left").drop("_s")
    marked = marked.join(s.withColumn("in_b", F.lit(1)), F.col("b") == F.col("_s"), "left").drop("_s")
    both, one = F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), F.col("in_a").isNotNull() | F.col("in_b").isNotNull()
    counts = marked.agg(F.count_if(both).alias("n_inner"), F.count_if(one & ~both).alias("n_outer"))
    n = F.col("n_inner") + F.col("n_outer")
    return counts.withColumn("cohesion", F.when(n > 0, F.col("n_inner") / n).otherwise(0.0))


def grid_edges(points: DataFrame, reach: float, rid: str = "rid", x: str = "x", y: str = "y") -> DataFrame:
    """a, b with a < b: places no further apart than reach. Cells of a grid as wide as the reach are the join's key, so that only places of
    a cell and its neighbours meet."""
    cell = lambda c: F.floor(F.col(c) / reach)
    a = points.select(F.col(rid).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), cell(x).alias("cx"), cell(y).alias("cy"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = points.select(F.col(rid).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"), cell(x).alias("gx"), cell(y).alias("gy"), F.explode(steps).alias("s"))
    b = b.withColumn("cx", F.col("gx") + F.col("s.i")).withColumn("cy", F.col("gy") + F.col("s.j"))
    near = F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2) <= reach * reach
    return a.join(b, ["cx", "cy"]).where((F.col("a") < F.col("b")) & near).select("a", "b")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each can be reached from. Labels are handed on and jump to their label's label, so that the
    rounds grow with the logarithm of a component's diameter; each round is written to the checkpoint folder."""
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:  # labels only get smaller, so it ends
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        passed = labels.join(around, labels.node == around.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jumps = passed.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = settled(passed.join(jumps, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            break
    return labels.select("node", F.col("label").alias("component"))


def hop_distances(edges: DataFrame, start: Column, most: int | None = None) -> DataFrame:
    """node, hops: the length of the shortest way from the nodes where `start` (on the column node) holds; others aren't listed. It goes
    on until no node is new, one round a hop; most: nodes further off than that aren't looked for."""
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = settled(both.select(F.col("a").alias("node")).distinct().where(start).withColumn("hops", F.lit(0)))
    rim, k = seen, 0
    while most is None or k < most:
        k += 1
        rim = settled(both.join(rim, both.a == rim.node).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(k)))
        if not rim.head(1):
            break
        seen = seen.unionByName(rim) if k % 20 else settled(seen.unionByName(rim))
    return seen
