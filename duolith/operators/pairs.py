"""Pairs of literals, one of each side, from contingency tables.

For a pair of columns, one aggregate over the aligned rows counts each pair of
atoms (a Boolean's truth, a category, a bucket). Sums of cells, by two prefix
sums for intervals, give the support of every pair of literals without another
look at the rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import ratio


def column_pairs(columns: DataFrame, single: bool = False) -> DataFrame:
    """left, right, kind_l, kind_r: pairs of usable columns of the two sides (side, cid, kind, gid) in different groups; a group of -1 or
    null is in no other's way. single: both sides are one table, so each pair once. Rows are columns of the data, few."""
    a = columns.where("side = 0").select(F.col("cid").alias("left"), F.col("kind").alias("kind_l"), F.col("gid").alias("gid_l"))
    b = columns.where("side = 1").select(F.col("cid").alias("right"), F.col("kind").alias("kind_r"), F.col("gid").alias("gid_r"))
    apart = (F.coalesce("gid_l", F.lit(-1)) == -1) | (F.coalesce("gid_r", F.lit(-1)) == -1) | (F.col("gid_l") != F.col("gid_r"))
    return a.join(b, apart & (F.col("left") < F.col("right")) if single else apart).select("left", "right", "kind_l", "kind_r")


def contingency(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """l, r, n and the margins n_l, n_r and all rows N. Nulls are an atom of their own, so that missing values can be told."""
    cells = df.groupBy(left.alias("l"), right.alias("r")).agg(F.count("*").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    return cells.select("l", "r", "n", over("l").alias("n_l"), over("r").alias("n_r"), over(F.lit(0)).alias("n_rows"))


def score_atoms(table: DataFrame, min_in: int = 1, min_out: int = 0) -> DataFrame:
    """l, r, n_inter, n_union, acc of each pair of atoms within the bounds, from a contingency table."""
    union = F.col("n_l") + F.col("n_r") - F.col("n")
    kept = table.where(F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("n") >= min_in) & (F.col("n_rows") - union >= min_out))
    return kept.select("l", "r", F.col("n").alias("n_inter"), union.alias("n_union"), ratio(F.col("n"), union).alias("acc"))


def score_intervals(table: DataFrame, min_in: int = 1, min_out: int = 0, atom: bool = False) -> DataFrame:
    """l_low, l_high, r_low, r_high (bucket numbers), n_inter, n_union, acc of all pairs of intervals, by prefix sums in both directions.

    atom: the left side's values are categories, taken one at a time. The buckets of a column are few (method parameter).
    """
    rows = table.select("n_rows").limit(1)
    grid = table.where("l IS NOT NULL AND r IS NOT NULL").select("l", "r", "n")
    ls, rs = grid.select("l").distinct(), grid.select("r").distinct()
    full = ls.join(rs, F.lit(True)).join(grid, ["l", "r"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = Window.orderBy("r").partitionBy("l").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy("l").partitionBy("r").rowsBetween(Window.unboundedPreceding, 0)
    sums = full.withColumn("row_sum", F.sum("n").over(upto))
    sums = sums if atom else sums.withColumn("row_sum", F.sum("row_sum").over(down))
    low_l, high_l = ls.select(F.col("l").alias("l_low")), ls.select(F.col("l").alias("l_high"))
    l_runs = low_l.join(high_l, F.col("l_low") == F.col("l_high") if atom else F.col("l_low") <= F.col("l_high"))
    r_runs = rs.select(F.col("r").alias("r_low")).join(rs.select(F.col("r").alias("r_high")), F.col("r_low") <= F.col("r_high"))
    before_l = ls.select("l", F.lag("l").over(Window.orderBy("l")).alias("l_before"))
    before_r = rs.select("r", F.lag("r").over(Window.orderBy("r")).alias("r_before"))
    runs = l_runs.join(before_l.withColumnRenamed("l", "l_low"), "l_low").join(r_runs.join(before_r.withColumnRenamed("r", "r_low"), "r_low"), F.lit(True))

    def corner(name: str, l: str, r: str) -> DataFrame:
        return sums.select(F.col("l").alias(l), F.col("r").alias(r), F.col("row_sum").alias(name))

    runs = runs.join(corner("c11", "l_high", "r_high"), ["l_high", "r_high"], "left").join(corner("c10", "l_high", "r_before"), ["l_high", "r_before"], "left")
    if atom:
        inter = F.coalesce("c11", F.lit(0)) - F.coalesce("c10", F.lit(0))
    else:
        runs = runs.join(corner("c01", "l_before", "r_high"), ["l_before", "r_high"], "left").join(corner("c00", "l_before", "r_before"), ["l_before", "r_before"], "left")
        inter = F.coalesce("c11", F.lit(0)) - F.coalesce("c10", F.lit(0)) - F.coalesce("c01", F.lit(0)) + F.coalesce("c00", F.lit(0))
    margins_l = table.where("l IS NOT NULL").select("l", "n_l").distinct()
    margins_r = table.where("r IS NOT NULL").select("r", "n_r").distinct()
    size_l = l_runs.join(margins_l, F.col("l").between(F.col("l_low"), F.col("l_high"))).groupBy("l_low", "l_high").agg(F.sum("n_l").alias("s_l"))
    size_r = r_runs.join(margins_r, F.col("r").between(F.col("r_low"), F.col("r_high"))).groupBy("r_low", "r_high").agg(F.sum("n_r").alias("s_r"))
    out = runs.withColumn("n_inter", inter).join(size_l, ["l_low", "l_high"]).join(size_r, ["r_low", "r_high"]).join(rows, F.lit(True))
    out = out.withColumn("n_union", F.col("s_l") + F.col("s_r") - F.col("n_inter"))
    kept = out.where((F.col("n_inter") >= min_in) & (F.col("n_rows") - F.col("n_union") >= min_out))
    return kept.select("l_low", "l_high", "r_low", "r_high", "n_inter", "n_union", ratio(F.col("n_inter"), F.col("n_union")).alias("acc"))


def combine_categories(cells: dict[tuple[str, str], int], n_l: dict[str, int], n_r: dict[str, int], exhaustive: int = 0) -> tuple[tuple[str, ...], tuple[str, ...], float]:
    """The sets of categories of two columns, joined by or, with the best accuracy: category by category as long as one helps, or of all
    sets up to a size. cells: counts of pairs; small, so on the driver."""

    def accuracy(ls: frozenset, rs: frozenset) -> float:
        inter = sum(n for (l, r), n in cells.items() if l in ls and r in rs)
        union = sum(n_l[l] for l in ls) + sum(n_r[r] for r in rs) - inter
        return inter / union if union else 0.0

    if exhaustive:
        sets = lambda every: [frozenset(c) for k in range(1, min(exhaustive, len(every) - 1) + 1) for c in combinations(sorted(every), k)]
        best = max(((accuracy(ls, rs), -len(ls) - len(rs), sorted(ls), sorted(rs)) for ls in sets(n_l) for rs in sets(n_r)), default=(0.0, 0, [], []))
        return tuple(best[2]), tuple(best[3]), best[0]
    if not cells:
        return (), (), 0.0
    l, r = max(sorted(cells), key=lambda k: accuracy(frozenset({k[0]}), frozenset({k[1]})))
    ls, rs = frozenset({l}), frozenset({r})
    while True:
        steps = [(ls | {x}, rs) for x in sorted(n_l) if x not in ls] + [(ls, rs | {x}) for x in sorted(n_r) if x not in rs]
        step = max(steps, key=lambda s: accuracy(*s), default=None)
        if step is None or accuracy(*step) <= accuracy(ls, rs):
            return tuple(sorted(ls)), tuple(sorted(rs)), accuracy(ls, rs)
        ls, rs = step


def conflict(a: dict, b: dict, strictness: str = "medium") -> bool:
    """Whether two pairs of literals on the same two columns are too alike to keep both.

    a, b: left and right as a set of categories or a (low, high) interval. low keeps the best of a pair of columns only, medium
    drops what is alike on either side, high what is alike on both, and extra nothing.
    """

    def alike(x, y) -> bool:
        if isinstance(x, tuple):
            return x[0] <= y[1] and y[0] <= x[1]
        return bool(set(x) & set(y))

    sides = [alike(a[s], b[s]) for s in ("left", "right")]
    return {"low": True, "medium": any(sides), "high": all(sides), "extra": False}[strictness]


def best_pairs(candidates: list[dict], strictness: str = "medium") -> list[dict]:
    """Candidates (left, right, acc) of one pair of columns from the best down, without those in conflict with a kept one."""
    kept: list[dict] = []
    for c in sorted(candidates, key=lambda c: (-c["acc"], str(c["left"]), str(c["right"]))):
        if not any(conflict(c, k, strictness) for k in kept):
            kept.append(c)
    return kept


def ranked(pairs: DataFrame, order: str = "overall", id_col: str = "pid") -> DataFrame:
    """pairs (pid, left, right, acc) with `place`, in which they are explored: overall by accuracy, alternate by accuracy less the
    worse of the ranks among the pairs of either column, fifo and filo by number."""
    if order in ("fifo", "filo"):
        return pairs.withColumn("place", F.row_number().over(Window.orderBy(F.col(id_col) if order == "fifo" else F.desc(id_col))))
    key = F.col("acc")
    if order == "alternate":
        rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("acc"), id_col)) - 1
        pairs = pairs.withColumn("rank_l", rank("left")).withColumn("rank_r", rank("right"))
        key = F.col("acc") - F.greatest("rank_l", "rank_r")
    return pairs.withColumn("place", F.row_number().over(Window.orderBy(F.desc(key), id_col))).drop("rank_l", "rank_r")


def top_with_ties(pairs: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in the order and all that tie with the last of them."""
    return pairs.withColumn("_rank", F.rank().over(Window.orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def without_double_negations(pairs: DataFrame) -> DataFrame:
    """Pairs (left, right, neg_l, neg_r, acc) without those negated on both sides that have the accuracy of the plain one."""
    plain = pairs.where("NOT neg_l AND NOT neg_r").select("left", "right", "acc")
    double = pairs.where("neg_l AND neg_r").join(plain, ["left", "right", "acc"], "left_semi")
    return pairs.join(double.select("left", "right", "neg_l", "neg_r"), ["left", "right", "neg_l", "neg_r"], "left_anti")


def best_per_key(candidates: DataFrame, key: list[str], score: str = "score", least: float = float("-inf")) -> DataFrame:
    """Of the candidates with the score or more, the best of each key."""
    rest = [c for c in candidates.columns if c not in key]
    best = candidates.where(F.col(score) >= least).groupBy(*key).agg(F.max(F.struct(F.col(score).alias("_s"), *rest)).alias("m"))
    return best.select(*key, *(f"m.{c}" for c in rest))
