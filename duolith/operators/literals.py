"""Literals of columns and buckets of numbers.

Bucketing works on the distinct values of a column with their counts, which
one aggregate gives. Equal-width edges are an expression; the stateful methods
walk over a column's distinct values in order, one column in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..expressions import INF, Bool, Cat, Literal, Num


def usable(long: DataFrame, min_in: int, min_out: int) -> DataFrame:
    """side, cid, kind of the columns that some literal can be made of.

    Booleans need support within the bounds, and categorical columns a category that has; a numerical one passes if the
    values that aren't its most frequent one are enough, or if they leave enough out.
    """
    totals = long.groupBy("side", "cid", "kind").agg(F.count("*").alias("n"), F.count_if("b").alias("n_true"))
    enough = lambda c: (c >= min_in) & (F.col("n") - c >= min_out)
    top = long.where("s IS NOT NULL OR n IS NOT NULL").groupBy("side", "cid", "s", F.col("n").alias("value")).agg(F.count("*").alias("size"))
    joined = totals.join(top, ["side", "cid"], "left")
    ok = F.when(F.col("kind") == 1, enough(F.col("n_true"))).when(F.col("kind") == 2, enough(F.col("size")))
    ok = ok.otherwise((F.col("n") - F.col("size") >= min_in) | (F.col("n") - F.col("size") <= F.col("n") - min_out))
    return joined.groupBy("side", "cid", "kind").agg(F.bool_or(F.coalesce(ok, F.lit(False))).alias("usable")).where("usable").drop("usable")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n: the distinct numbers of a column with their counts; nulls are missing."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def equal_width(column: Column, low: float, high: float, k: int) -> Column:
    """The bucket, 0 to k - 1, of each value between low and high; null is in none."""
    if high <= low:
        return F.when(column.isNotNull(), F.lit(0))
    return F.least(F.floor((column - low) * k / (high - low)), F.lit(k - 1)).cast("int")


def by_edges(column: Column, edges: Sequence[float]) -> Column:
    """The bucket by rising lower edges: how many edges are at or below the value, less one."""
    return F.when(column.isNotNull(), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= column)) - 1)


def collapse(values: Sequence[float], counts: Sequence[float], most: float, check_next: bool = False, alone: int | None = None) -> list[tuple[float, float, int]]:
    """Low, high, rows of buckets of neighbouring values. A bucket is closed once it has more than `most` rows, before a value that
    has so many by itself (check_next), and around the value at the place `alone`."""
    out: list[list] = []
    for i, (v, n) in enumerate(zip(values, counts)):
        if out and not (out[-1][2] > most or (check_next and n > most) or (alone is not None and i in (alone, alone + 1))):
            out[-1][1:] = [v, out[-1][2] + n]
        else:
            out.append([v, v, n])
    return [tuple(b) for b in out]


def similar_height(values: Sequence[float], counts: Sequence[float], rows: int, k: int, mode_rows: int = 0) -> list[tuple[float, float, int]]:
    """Buckets of about rows / k rows; where one value alone has more, the others share the remaining buckets."""
    most = rows / k
    if mode_rows > most and k > 1:
        most = (rows - mode_rows) / (k - 1)
    return collapse(values, counts, most, check_next=True)


def tails(values: Sequence[float], counts: Sequence[float], lower: float, upper: float) -> list[tuple[float, float, int]]:
    """Each value a bucket in both tails, one bucket between them. A tail of 1 or more is in rows, of 0 to 1 a share of the rows, of -1
    to 0 a share of the values, below -1 in values."""
    counts = list(counts)
    singles = [(v, v, n) for v, n in zip(values, counts)]
    if not lower or not upper:
        return singles

    def reach(tail: float, ns: list) -> int:
        if tail < -1:
            return int(-tail)
        if tail < 0:
            return 0 if tail == -1 else int(-tail * len(ns))
        rows = tail if tail >= 1 else tail * sum(ns)
        return int(np.searchsorted(np.cumsum(ns), rows, side="left"))

    a, b = reach(lower, counts), len(counts) - reach(upper, counts[::-1]) - 1
    if a >= b:
        return singles
    return [*singles[:a], (values[a], values[b - 1], sum(counts[a:b])), *singles[b:]]


def segments(values: Sequence[float], counts: Sequence[float], k: int, criterion: str = "manual") -> list[tuple[float, float, int]]:
    """At most k buckets with the least squared error of the standardised values, by dynamic programming over the distinct values.

    criterion BIC or AIC: more buckets are taken only while they lower the error by more than their price.
    """
    v, c = np.asarray(values, float), np.asarray(counts, float)
    rows, spread = c.sum(), math.sqrt(max((c * v * v).sum() / c.sum() - ((c * v).sum() / c.sum()) ** 2, 0)) or 1.0
    z = (v - (c * v).sum() / rows) / spread
    n = len(z)
    s0, s1, s2 = (np.concatenate([[0.0], np.cumsum(c * z**p)]) for p in range(3))
    error = lambda i, j: s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / (s0[j] - s0[i])  # noqa: E731  of the values i to j - 1; vectorised over i
    price = {"manual": 0.0, "BIC": math.log(rows), "AIC": 2.0}[criterion]
    best = np.array([error(0, j) if j else 0.0 for j in range(n + 1)])
    back, costs = [np.zeros(n + 1, int)], [best[n]]
    for m in range(1, min(k, n)):
        new, at = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(m + 1, n + 1):
            i = np.arange(m, j)
            total = best[i] + error(i, j)
            at[j] = i[np.argmin(total)]
            new[j] = total.min()
        if new[n] + m * price >= costs[-1] + (m - 1) * price:
            break
        best = new
        back.append(at)
        costs.append(new[n])
    cuts = [n]
    for at in back[:0:-1]:
        cuts.insert(0, int(at[cuts[0]]))
    edges = [0, *cuts]
    return [(float(v[a]), float(v[b - 1]), int(c[a:b].sum())) for a, b in zip(edges, edges[1:])]


#: Distinct values of one column that a task is given at most.
MOST_VALUES = 1_000_000


def coarse(histogram: DataFrame, cells: int = MOST_VALUES // 10) -> DataFrame:
    """cid, value, n with at most so many values a column: those in a cell of an equal-width grid become the least of them."""
    ends = histogram.groupBy("cid").agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / cells
    cell = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_a")) / width), F.lit(cells - 1))).otherwise(0)
    return histogram.join(ends, "cid").groupBy("cid", cell.alias("_cell")).agg(F.min("value").alias("value"), F.sum("n").alias("n")).drop("_cell")


def bucketize(histogram: DataFrame, method: str, k: int = 25, *, most: float | None = None, lower: float = 0, upper: float = 1, criterion: str = "manual") -> DataFrame:
    """cid, bucket, low, high, n of each column. histogram: cid, value, n, the distinct values of one or more columns.

    One task has the distinct values of a column; columns are spread over tasks. A column with more than MOST_VALUES of them is
    refused: `coarse` puts them into fewer first.
    """
    many = histogram.groupBy("cid").agg(F.count("*").alias("n")).where(F.col("n") > MOST_VALUES).head(1)
    if many:
        raise ValueError(f"{many[0]['cid']} has {many[0]['n']} distinct values, more than {MOST_VALUES}; pass the histogram through coarse() first")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        values, counts = pdf["value"].tolist(), pdf["n"].tolist()
        if method == "similar-height":
            made = similar_height(values, counts, sum(counts), k, max(counts))
        elif method == "collapsed":
            made = collapse(values, counts, most if most is not None else sum(counts) / k)
        elif method == "tails":
            made = tails(values, counts, lower, upper)
        elif method == "bellman":
            made = segments(values, counts, k, criterion)
        elif method == "equal-width":
            at = np.minimum(np.floor((np.array(values) - values[0]) * k / ((values[-1] - values[0]) or 1)), k - 1)
            made = [(values[i[0]], values[i[-1]], sum(counts[j] for j in i)) for b in np.unique(at) for i in [np.flatnonzero(at == b)]]
        else:
            raise ValueError(method)
        return pd.DataFrame({"cid": pdf["cid"].iloc[0], "bucket": range(len(made)), "low": [float(b[0]) for b in made], "high": [float(b[1]) for b in made], "n": [int(b[2]) for b in made]})

    return histogram.groupBy("cid").applyInPandas(one, "cid string, bucket int, low double, high double, n long")


def part_histogram(df: DataFrame, value: str, part: Column) -> DataFrame:
    """value, part, n."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value"), part.alias("part")).agg(F.count("*").alias("n"))


def feasible(histogram: DataFrame, side: int, min_in: int, min_out: int) -> DataFrame:
    """op, possible: whether some interval of a column could keep the bounds when it is joined to a side. histogram: value, part, n.

    By and, what is in both may stay, and what only the side holds for may go; by or, what only the other side holds for may come.
    """
    n = {p: F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)) for p in ("Exx", "Exo", "Eox", "Eoo")}
    mine, theirs = (n["Exo"], n["Eox"]) if side == 0 else (n["Eox"], n["Exo"])
    tests = {"and": (n["Exx"] >= min_in) & (n["Eoo"] + mine >= min_out), "or": (n["Exx"] + theirs >= min_in) & (n["Eoo"] >= min_out)}
    made = histogram.agg(*(t.alias(op) for op, t in tests.items()))
    return made.select(F.explode(F.array(*(F.struct(F.lit(op).alias("op"), F.col(f"`{op}`").alias("possible")) for op in tests))).alias("e")).select("e.*")


def pure_blocks(histogram: DataFrame, numerator: Iterable[str], denominator: Iterable[str]) -> DataFrame:
    """block, low, high, num, den: runs of neighbouring values that add to the numerator alone or to the denominator alone, as one block;
    a value that adds to both is a block of its own, and one that adds to none belongs to no block.

    histogram: value, part, n. A gap-and-island window over the distinct values of one column.
    """
    num, den = (F.sum(F.when(F.col("part").isin(*p), F.col("n")).otherwise(0)) for p in (list(numerator), list(denominator)))
    per = histogram.groupBy("value").agg(num.alias("num"), den.alias("den")).where("num + den > 0")
    kind = F.when(F.col("num") == 0, "den").when(F.col("den") == 0, "num").otherwise("both")
    order = Window.orderBy("value")
    starts = (F.col("kind") == "both") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    marked = per.withColumn("kind", kind).withColumn("start", starts.cast("int"))
    blocks = marked.withColumn("block", F.sum("start").over(order) - 1)
    return blocks.groupBy("block").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("num").alias("num"), F.sum("den").alias("den"))


def best_interval(blocks: DataFrame, num_out: int, den_out: int, min_in: int = 1, key: Sequence[str] = ()) -> DataFrame:
    """The key, low, high, num, den, acc of the best interval of blocks: the accuracy is (num_out + num) / (den_out + num + den) with the sums
    inside, at least min_in rows. Of equally good ones the shortest, then the first.

    blocks: the key (of a column), block, low, high, num, den. The blocks of one column are walked over in one task, a few passes of
    running sums and no pairs of ends; columns are spread over tasks.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        num, den = pdf["num"].to_numpy(), pdf["den"].to_numpy()
        found = best_run(num, num + den, num_out, den_out, least=min_in, sizes=num + den)
        if found is None:
            return pdf.iloc[:0].assign(acc=0.0)[[*key, "low", "high", "num", "den", "acc"]]
        i, j, acc = found
        head = {k: [pdf[k].iloc[0]] for k in key}
        return pd.DataFrame(head | {"low": [pdf["low"].iloc[i]], "high": [pdf["high"].iloc[j]], "num": [int(num[i : j + 1].sum())], "den": [int(den[i : j + 1].sum())], "acc": [acc]})

    types = dict(blocks.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), f"low {types['low']}", f"high {types['high']}", "num long", "den long", "acc double"])
    return blocks.withColumn("_one", F.lit(0)).groupBy(*(key or ["_one"])).applyInPandas(one, schema)


def best_run(a: Sequence[float], b: Sequence[float], num_out: float, den_out: float, negative: bool = False, least: float = 0, sizes: Sequence[float] | None = None) -> tuple[int, int, float] | None:
    """First and last block and ratio of the best interval: (num_out + sum of a) / (den_out + sum of b) inside, or with negative outside it.
    sizes and least: only intervals with so much in them. Of equally good ones the shortest, then the first; none without any.

    For a trial ratio the best interval has the largest sum of a - ratio * b, which one pass of running sums finds; its own
    ratio is the next trial, until none is better. A few passes, however many blocks.
    """
    n = len(a)
    if not n:
        return None
    a, b = np.asarray(a, float), np.asarray(b, float)
    top, bottom = (num_out + a.sum(), den_out + b.sum()) if negative else (num_out, den_out)
    sign = -1.0 if negative else 1.0
    sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (a, b)]
    held = np.concatenate([[0.0], np.cumsum(np.ones(n) if sizes is None else np.asarray(sizes, float))])
    # for each end the last start at which the interval is large enough
    latest = np.minimum(np.searchsorted(held, held[1:] - least, side="right") - 1, np.arange(n))
    ends = np.flatnonzero(latest >= 0)
    if not len(ends):
        return None

    def ratio(i: int, j: int) -> float:
        x, y = (top + sign * (sums[0][j + 1] - sums[0][i])), (bottom + sign * (sums[1][j + 1] - sums[1][i]))
        return x / y if y else (np.inf if x else 0.0)

    best = (0, int(ends[0]))
    trial = ratio(*best)
    while np.isfinite(trial):
        upto = sign * (sums[0] - trial * sums[1])
        lowest = np.minimum.accumulate(upto[:-1])
        gains = upto[ends + 1] - lowest[latest[ends]]
        k = int(np.argmax(gains))
        j = int(ends[k])
        i = int(np.argmin(upto[: latest[j] + 1]))
        new = ratio(i, j)
        if new <= trial * (1 + 1e-15):
            break
        best, trial = (i, j), new
    if not np.isfinite(trial):
        return (*best, trial)
    # all that are as good: of each such end the last such start
    scale = 1e-9 * max(1.0, np.abs(upto).max())
    ties = []
    for k in np.flatnonzero(gains >= gains.max() - scale).tolist():
        j = int(ends[k])
        near = np.flatnonzero(upto[: latest[j] + 1] <= lowest[latest[j]] + scale)
        ties += [(j - int(i), int(i), j) for i in near[::-1][:8] if ratio(int(i), j) >= trial * (1 - 1e-12)]
    _, i, j = min(ties, default=(0, *best))
    return i, j, float(ratio(i, j))


def running_cover(num: Sequence[float], den: Sequence[float], num_out: float, den_out: float, negative: bool = False) -> tuple[int, int, float] | None:
    """best_run for an accuracy: (num_out + num) / (den_out + num + den) with the sums inside, or outside."""
    a, b = np.asarray(num, float), np.asarray(den, float)
    return best_run(a, a + b, num_out, den_out, negative)


def category_literal(var: str, chosen: Sequence[str], every: Sequence[str], negation: bool = True) -> Literal | None:
    """The literal of some categories: as the complement where that is shorter; none for all or no categories."""
    rest = [v for v in every if v not in set(chosen)]
    if not chosen or not rest:
        return None
    return Cat(var, tuple(rest), neg=True) if negation and len(rest) < len(chosen) else Cat(var, tuple(chosen))


def interval_literal(var: str, bounds: Sequence[tuple[float, float]], first: int, last: int) -> Literal | None:
    """The literal of the buckets first to last: open at either end of the column; none for the whole column."""
    low = -INF if first == 0 else bounds[first][0]
    high = INF if last == len(bounds) - 1 else bounds[last][1]
    return None if low == -INF and high == INF else Num(var, low, high)


def rounded(bound: float, histogram: Sequence[float], digits: int = 12, upper: bool = False) -> float:
    """The bound of an interval with as few decimals as select the same of the distinct values; upper: it is the greatest of them."""
    key = (lambda v: v <= bound) if upper else (lambda v: v >= bound)
    wanted = [key(v) for v in histogram]
    for d in range(digits):
        r = round(bound, d)
        if [(v <= r) if upper else (v >= r) for v in histogram] == wanted:
            return r
    return bound


def initial_literals(long: DataFrame, buckets: DataFrame, min_in: int, min_out: int, rows: int) -> DataFrame:
    """side, cid, kind, category, low, high, n: Booleans, single categories and runs of buckets with support within the bounds."""
    fits = (F.col("n") >= min_in) & (F.col("n") <= rows - min_out)
    none = lambda t: F.lit(None).cast(t)
    flags = long.where("b").groupBy("side", "cid").agg(F.count("*").alias("n")).select("side", "cid", F.lit(1).alias("kind"), none("string").alias("category"), none("double").alias("low"), none("double").alias("high"), "n")
    cats = long.where("s IS NOT NULL").groupBy("side", "cid", "s").agg(F.count("*").alias("n")).select("side", "cid", F.lit(2).alias("kind"), F.col("s").alias("category"), none("double").alias("low"), none("double").alias("high"), "n")
    order = Window.partitionBy("side", "cid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = buckets.withColumn("upto", F.sum("n").over(order))
    a, b = sums.alias("a"), sums.alias("b")
    runs = a.join(b, (F.col("a.side") == F.col("b.side")) & (F.col("a.cid") == F.col("b.cid")) & (F.col("a.bucket") <= F.col("b.bucket")))
    nums = runs.select("a.side", "a.cid", F.lit(3).alias("kind"), none("string").alias("category"), F.col("a.low").alias("low"), F.col("b.high").alias("high"), (F.col("b.upto") - F.col("a.upto") + F.col("a.n")).alias("n"))
    return flags.unionByName(cats).unionByName(nums).where(fits)


def literal_of(row) -> Literal:
    """A row of initial_literals as a literal."""
    return {1: lambda: Bool(row["cid"]), 2: lambda: Cat(row["cid"], (row["category"],)), 3: lambda: Num(row["cid"], row["low"], row["high"])}[row["kind"]]()


def same_rows(histogram: Sequence[float], a: float, b: float) -> bool:
    """Whether two thresholds have the same values on either side. histogram: the distinct values."""
    low, high = min(a, b), max(a, b)
    return not any(low < v <= high for v in histogram)
