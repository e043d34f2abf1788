"""Folds, learn and test sets, and randomised copies of the data."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..expressions import Node, to_column
from .support import ratio


def drawn(seed: int, *key: Column | str) -> Column:
    """A number that only the seed and the key decide: the first 48 bits of their MD5, so that any engine draws the same."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("null")) for k in key))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def random_folds(df: DataFrame, k: int, seed: int = 0, rid: str = "rid") -> DataFrame:
    """df with fold, 0 to k - 1, by a seeded hash of the row number: reruns agree, no row moves, sizes are near equal."""
    return df.withColumn("fold", F.pmod(drawn(seed, rid), F.lit(k)).cast("int"))


def equal_folds(df: DataFrame, k: int, seed: int = 0, rid: str = "rid") -> DataFrame:
    """Folds whose sizes differ by one at most: the place in the seeded order modulo k, by a range-partitioned numbering."""
    from .align import numbered

    keyed = df.withColumn("_h", drawn(seed, rid))
    return numbered(keyed, "_place", ["_h", rid]).withColumn("fold", (F.col("_place") % k).cast("int")).drop("_h", "_place")


def grouped_folds(df: DataFrame, k: int, by: Column, seed: int = 0) -> DataFrame:
    """Rows with an equal value are in one fold; values are dealt by a seeded hash. For numbers, pass floor(value * grain)."""
    return df.withColumn("fold", F.pmod(drawn(seed, by), F.lit(k)).cast("int"))


def column_folds(df: DataFrame, column: str) -> DataFrame:
    """Folds that a categorical or Boolean column names; the column is taken out, and the fold is written as F:value; rows without a value
    are in no fold."""
    return df.withColumn("fold", F.concat(F.lit("F:"), F.col(column).cast("string"))).drop(column)


def with_fold_column(df: DataFrame, fold: str = "fold", name: str = "folds_split") -> tuple[DataFrame, dict[str, int]]:
    """df with its folds as a categorical column of F:0, F:1, ... that can be mined, exported and read again by column_folds; and the
    column's kind for the catalogue."""
    from .align import CATEGORICAL

    return df.withColumn(name, F.concat(F.lit("F:"), F.col(fold).cast("string"))).drop(fold), {name: CATEGORICAL}


def fold_candidates(df: DataFrame, most: int = 20) -> list[str]:
    """The columns that could name folds: strings and Booleans with two to `most` values, each on as many rows as another but for one
    in ten. One aggregate."""
    names = [c for c, t in df.dtypes if t in ("string", "boolean")]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in names))).alias("e")
    sizes = df.select(cells).where("e.v IS NOT NULL").groupBy("e.c", "e.v").agg(F.count("*").alias("n")) if names else None
    if sizes is None:
        return []
    spread = sizes.groupBy("c").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max("n").alias("most"))
    good = spread.where(F.col("k").between(2, most) & (F.col("most") <= F.col("least") + F.greatest(F.lit(1), F.floor(F.col("least") / 10))))
    return sorted(r["c"] for r in good.select("c").collect())


def fold_accuracies(df: DataFrame, queries: tuple[Node, Node], fold: str = "fold") -> DataFrame:
    """fold, acc_learn (all other rows), acc_test (its own), ratio of the two. One aggregate by fold, the rest from its sums."""
    l, r = (to_column(q) for q in queries)
    per = df.groupBy(F.col(fold).alias("fold")).agg(F.count_if(l & r).alias("i"), F.count_if(l | r).alias("u"))
    every = Window.partitionBy(F.lit(0))
    learn = ratio(F.sum("i").over(every) - F.col("i"), F.sum("u").over(every) - F.col("u"))
    test = ratio(F.col("i"), F.col("u"))
    return per.select("fold", learn.alias("acc_learn"), test.alias("acc_test")).withColumn("acc_ratio", ratio(F.col("acc_test"), F.col("acc_learn")))


def run_folds(df: DataFrame, k: int, mine: Callable[[DataFrame], list[tuple[Node, Node]]], seed: int = 0) -> list[dict]:
    """Mine on all but each fold, evaluate on all rows and by learn and test set; equal redescriptions are merged."""
    from .extend import canonical

    folded = random_folds(df, k, seed)
    found: dict[tuple[str, str], dict] = {}
    for f in range(k):
        for queries in mine(folded.where(F.col("fold") != f)):
            found.setdefault(canonical(queries), {"queries": queries, "folds": []})["folds"].append(f)
    for x in found.values():
        rows = fold_accuracies(folded, x["queries"]).orderBy("fold").collect()
        x["acc_learn"], x["acc_test"] = ([r[c] for r in rows if r["fold"] in x["folds"]] for c in ("acc_learn", "acc_test"))
    return list(found.values())


def fold_summary(accuracies: DataFrame) -> DataFrame:
    """mean, std, least and most of the accuracies on the test sets."""
    return accuracies.agg(F.avg("acc_test").alias("mean"), F.stddev_pop("acc_test").alias("std"), F.min("acc_test").alias("least"), F.max("acc_test").alias("most"))


def permuted(df: DataFrame, columns: list[str], seed: int = 0, rid: str = "rid") -> DataFrame:
    """df with the rows of one side's columns in another, seeded order: both orders are numbered and joined."""
    from .align import numbered

    rest = [c for c in df.columns if c not in columns]
    base = numbered(df.select(*rest), "_n", [rid])
    mixed = numbered(df.select(*columns, drawn(seed, rid).alias("_h"), F.col(rid).alias("_r")), "_n", ["_h", "_r"]).select("_n", *columns)
    return base.join(mixed, "_n").drop("_n").select(*df.columns)


def shuffled_within(long: DataFrame, key: str, value: str, seed: int = 0) -> DataFrame:
    """The values of each key in another, seeded order over its rows (key, rid, value): for traits, each on its own."""
    rows = long.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("rid")))
    order = Window.partitionBy(key).orderBy(drawn(seed, key, "rid"), "rid")
    mixed = long.select(key, F.col(value).alias("_v"), F.row_number().over(order).alias("_n"))
    return rows.join(mixed, [key, "_n"]).withColumn(value, F.col("_v")).drop("_v", "_n")


def swapped(table: np.ndarray, swaps: int, seed: int = 0) -> np.ndarray:
    """A 0/1 table after so many tries to swap a checkerboard; row and column sums stay. Each step depends on the last, so it is for
    one task: a table that fits there."""
    rng, out = np.random.default_rng(seed), table.copy()
    ones = [tuple(x) for x in np.argwhere(out)]
    if len(ones) < 2:
        return out
    for _ in range(swaps):
        x, y = rng.integers(0, len(ones), 2)
        (i, j), (k, l) = ones[x], ones[y]
        if i != k and j != l and not out[i, l] and not out[k, j]:
            out[i, j] = out[k, l] = 0
            out[i, l] = out[k, j] = 1
            ones[x], ones[y] = (i, l), (k, j)
    return out


def swapped_blocks(ones: DataFrame, rounds: int, block_rows: int = 1000, seed: int = 0, swaps: int = 5000) -> DataFrame:
    """rid, cid of the true cells of a 0/1 table (ones: rid, cid) after checkerboard swaps that keep all row and column sums.

    In each round the rows are dealt anew to blocks of about block_rows, and each block swaps among its own rows in one task; a swap inside a
    block changes no sum of the whole table. No task has more than a block, whose columns are those of its rows.
    """
    import pandas as pd

    from ..functions.settle import settled

    now = settled(ones.select("rid", "cid").distinct())
    rows = now.select("rid").distinct().count()
    blocks = max(1, -(-rows // block_rows))
    for r in range(rounds):

        def swap(pdf: pd.DataFrame, r: int = r) -> pd.DataFrame:
            rids, i = np.unique(pdf["rid"], return_inverse=True)
            cids, j = np.unique(pdf["cid"], return_inverse=True)
            table = np.zeros((len(rids), len(cids)), np.int8)
            table[i, j] = 1
            i, j = np.nonzero(swapped(table, swaps, seed * 1009 + r))
            return pd.DataFrame({"rid": rids[i], "cid": cids[j]})

        keyed = now.withColumn("_block", F.pmod(drawn(seed + r, "rid"), F.lit(blocks)))
        now = settled(keyed.groupBy("_block").applyInPandas(lambda pdf: swap(pdf[["rid", "cid"]]), now.schema))  # noqa: B023
    return now


def selected_rows(df: DataFrame, queries: tuple[Node, Node], area: str = "inter") -> DataFrame:
    """The rows of a redescription: where both queries hold, or one of them (union)."""
    l, r = (to_column(q) for q in queries)
    return df.where(l & r if area == "inter" else l | r)


def randomised_pvalue(df: DataFrame, queries: tuple[Node, Node], right_columns: list[str], copies: int, seed: int = 0) -> float:
    """The share of copies with one side permuted, and of the data itself, in which the pair is as accurate."""
    from .support import evaluate

    accs = [evaluate(permuted(df, right_columns, seed + i), [queries]).first()["acc"] for i in range(copies)]
    own = evaluate(df, [queries]).first()["acc"]
    return (1 + sum(a >= own for a in accs)) / (1 + copies)
