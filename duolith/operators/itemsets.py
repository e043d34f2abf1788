"""Redescriptions from frequent itemsets: literals of both sides as items, split by side and kept if the two halves agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expressions import Literal, to_column


def transactions(df: DataFrame, left: Sequence[Literal], right: Sequence[Literal]) -> DataFrame:
    """items: an array of L0, L1, ... and R0, R1, ... for the literals that hold in each row."""
    items = [F.when(to_column(x), F.lit(f"{s}{i}")) for s, lits in (("L", left), ("R", right)) for i, x in enumerate(lits)]
    return df.select(F.array_compact(F.array(*items)).alias("items"))


def mine(rows: DataFrame, min_support: float, *, max_length: tuple[int, int] = (3, 3), min_jaccard: float = 0.0, excluded: Sequence[frozenset[str]] = ()) -> DataFrame:
    """left, right (sorted arrays of items), n_inter, n_left, n_right, jaccard of the frequent itemsets with items of both sides.

    Each side's part of a frequent itemset is frequent, too, so its support is in the same table: two equi-joins on the parts
    give the sizes. excluded: sets of items that mustn't be together, as literals of one column.
    """
    frequent = FPGrowth(itemsCol="items", minSupport=min_support).fit(rows).freqItemsets
    side = lambda s: F.array_sort(F.filter("items", lambda x: x.startswith(s)))
    sets = frequent.select(side("L").alias("left"), side("R").alias("right"), F.col("freq").alias("n_inter"))
    for bad in excluded:
        sets = sets.where(F.size(F.array_intersect(F.concat("left", "right"), F.array(*map(F.lit, sorted(bad))))) < 2)
    both = sets.where((F.size("left") > 0) & (F.size("right") > 0) & (F.size("left") <= max_length[0]) & (F.size("right") <= max_length[1]))
    lefts = sets.where((F.size("right") == 0) & (F.size("left") > 0)).select("left", F.col("n_inter").alias("n_left"))
    rights = sets.where((F.size("left") == 0) & (F.size("right") > 0)).select("right", F.col("n_inter").alias("n_right"))
    joined = both.join(lefts, "left").join(rights, "right")
    return joined.withColumn("jaccard", F.col("n_inter") / (F.col("n_left") + F.col("n_right") - F.col("n_inter"))).where(F.col("jaccard") >= min_jaccard)
