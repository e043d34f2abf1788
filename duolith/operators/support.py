"""Parts of the rows by the two sides' queries, and the statistics on their sizes.

A part is named by whether the left and the right query hold: x true, o false,
m unknown. With P sides n, all counts of a pair of queries are one aggregate
over one pass of the aligned rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expressions import Node, length, to_column
from ..functions.significance import binomial_tail, hypergeometric_tail, pvalue_overlap, pvalue_support

PARTS = ("Exo", "Eox", "Exx", "Eoo", "Exm", "Emx", "Eom", "Emo", "Emm")
# What counts as the intersection and what else counts in the union, by way of dealing with missing values. Fixed values.
TYPES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "none": (("Exx",), ("Exo", "Eox")),
    "rejective": (("Exx",), ("Exo", "Eox")),
    "optimistic": (("Exx", "Exm", "Emx", "Emm"), ("Exo", "Eox")),
    "pessimistic": (("Exx",), ("Exo", "Eox", "Exm", "Emx", "Eom", "Emo", "Emm")),
    "positive": (("Exx", "Exm", "Emx", "Emm"), ("Exo", "Eox", "Eom", "Emo")),
    "negative": (("Exx",), ("Exo", "Eox", "Exm", "Emx")),
    "exclu": (("Exo", "Eox"), ("Exx",)),
}


def default_type(missing: bool) -> str:
    return "rejective" if missing else "none"


def part(left: Column, right: Column) -> Column:
    """The name of each row's part."""
    mark = lambda c: F.when(c, "x").when(~c, "o").otherwise("m")
    return F.concat(F.lit("E"), mark(left), mark(right))


def part_counts(left: Column, right: Column) -> list[Column]:
    """A conditional count for each part, in one aggregate without a shuffle of rows."""
    p = part(left, right)
    return [F.count_if(p == name).alias(name) for name in PARTS]


def total(names: tuple[str, ...], counts: Mapping[str, Column] | None = None) -> Column:
    out = F.lit(0).cast("long")
    for n in names:
        out = out + (counts[n] if counts else F.col(n))
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 / 0 is 0 and a / 0 infinite."""
    return F.when(b == 0, F.when(a == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(a / F.when(b != 0, b))


def accuracy(kind: str = "none") -> Column:
    """Jaccard of the supports, from columns with the counts of the parts."""
    inter, diff = TYPES[kind]
    return ratio(total(inter), total(inter) + total(diff))


def lengths(kind: str = "none") -> dict[str, Column]:
    """Sizes by letter: P sum of all, I intersection, U union, L and R the sides, O uncovered, A and B the sides alone, D difference, N all rows."""
    inter, diff = TYPES[kind]
    left = tuple(p for p in inter + diff if p[1] == "x" or (p in inter and p[1] == "m"))
    right = tuple(p for p in inter + diff if p[2] == "x" or (p in inter and p[2] == "m"))
    everything = total(PARTS)
    union = total(inter) + total(diff)
    return {
        "I": total(inter), "U": union, "L": total(left), "R": total(right), "O": everything - union,
        "D": total(diff), "A": total(tuple(p for p in left if p not in inter)), "B": total(tuple(p for p in right if p not in inter)), "N": everything,
    }


def support(df: DataFrame, query: Node) -> DataFrame:
    """n_true, n_missing, n_false of a query over the rows."""
    c = to_column(query)
    return df.agg(F.count_if(c).alias("n_true"), F.count_if(c.isNull()).alias("n_missing"), F.count_if(~c).alias("n_false"))


def evaluate(df: DataFrame, pairs: list[tuple[Node, Node]], kind: str = "none", restrict: Column | None = None) -> DataFrame:
    """A row for each pair of queries: pair, the counts of the parts, acc; one scan of the rows.

    Each row says for each pair in which part it is, as one number; the numbers are counted where the rows are read, so that a task
    gives nine counts a pair at most, however many rows it has. restrict: counts only rows where it holds, for learn and test sets.
    """
    rows = df.where(restrict) if restrict is not None else df
    queries = list(dict.fromkeys(q for p in pairs for q in p))
    place = {q: i for i, q in enumerate(queries)}
    code = lambda c: F.when(c, 0).when(~c, 1).otherwise(2)
    said = rows.select(*(code(to_column(q)).alias(f"q{i}") for i, q in enumerate(queries)))
    codes = F.array(*(9 * i + 3 * F.col(f"q{place[l]}") + F.col(f"q{place[r]}") for i, (l, r) in enumerate(pairs)))
    seen = said.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    number = {f"E{a}{b}": 3 * i + j for i, a in enumerate("xom") for j, b in enumerate("xom")}
    counts = seen.groupBy(F.floor(F.col("code") / 9).cast("int").alias("pair")).agg(*(F.sum(F.when(F.col("code") % 9 == number[p], F.col("n")).otherwise(0)).alias(p) for p in PARTS))
    every = df.sparkSession.range(len(pairs)).select(F.col("id").cast("int").alias("pair"))  # pairs of an empty table, too
    full = every.join(F.broadcast(counts), "pair", "left").select("pair", *(F.coalesce(p, F.lit(0)).cast("long").alias(p) for p in PARTS))
    return full.withColumn("acc", accuracy(kind))


def with_pvalues(counts: DataFrame, method: str = "over", kind: str = "none", left_p: Column | None = None, right_p: Column | None = None) -> DataFrame:
    """counts with pval: of an overlap as large by chance given both sizes (over), given both shares of the rows (marg), or given
    the queries' own probabilities left_p and right_p (supp). For exclu the union's size bounds the intersection from above."""
    n = lengths(kind)
    size = n["I"].alias("k")
    if method == "over":
        return counts.withColumn("pval", pvalue_overlap(size, n["N"], n["L"], n["R"]))
    p, q = (left_p, right_p) if method == "supp" else (n["L"] / n["N"], n["R"] / n["N"])
    return counts.withColumn("pval", pvalue_support(size, n["N"], p * q))


def measured(counts: Mapping[str, int], method: str = "over", kind: str = "none") -> dict[str, float]:
    """n_inter, n_out and pval of one redescription from the counts of its parts, on the driver."""
    inter, diff = TYPES[kind]
    size = lambda names: sum(counts[p] for p in names)
    n, i, u = size(PARTS), size(inter), size(inter + diff)
    left, right = (size([p for p in inter + diff if p[s] == "x" or (p in inter and p[s] == "m")]) for s in (1, 2))
    pval = hypergeometric_tail(i, n, left, right) if method == "over" else binomial_tail(i, n, left * right / (n * n) if n else 0.0)
    return {"n_inter": i, "n_out": n - u, "pval": pval}


def area(node: Node, size: Column) -> Column:
    """A query's length times the size of a support."""
    return F.lit(length(node)) * size


def overlap(df: DataFrame, a: tuple[Node, Node], b: tuple[Node, Node]) -> DataFrame:
    """Rows that two pairs of queries have in common: n_inter, n_union, ratio, fract_min, over where both sides of a pair hold."""
    x, y = (to_column(l) & to_column(r) for l, r in (a, b))
    counts = df.agg(F.count_if(x & y).alias("n_inter"), F.count_if(x | y).alias("n_union"), F.least(F.count_if(x), F.count_if(y)).alias("n_least"))
    return counts.select("n_inter", "n_union", ratio(F.col("n_inter"), F.col("n_union")).alias("ratio"), ratio(F.col("n_inter"), F.col("n_least")).alias("fract_min"))


def overlaps(df: DataFrame, a: tuple[Node, Node], b: tuple[Node, Node]) -> DataFrame:
    """what (rows, cols, area), n_inter, n_union, ratio, fract_min of two pairs of queries: of the rows where both sides hold, of the columns
    that the queries name, and of the rectangles of both."""
    from ..expressions import variables

    names = [set().union(*({(s, v) for v in variables(q)} for s, q in enumerate(p))) for p in (a, b)]
    x, y = (to_column(l) & to_column(r) for l, r in (a, b))
    n = df.agg(F.count_if(x & y).alias("i"), F.count_if(x).alias("x"), F.count_if(y).alias("y"))
    cx, cy, ci = (F.lit(len(c)).cast("long") for c in (*names, names[0] & names[1]))
    i, x, y = (F.col(c) for c in "ixy")
    rows = [("rows", i, x, y), ("cols", ci, cx, cy), ("area", i * ci, x * cx, y * cy)]
    made = F.array(*(F.struct(F.lit(w).alias("what"), k.alias("n_inter"), (p + q - k).alias("n_union"), F.least(p, q).alias("n_least")) for w, k, p, q in rows))
    out = n.select(F.explode(made).alias("r")).select("r.*")
    return out.select("what", "n_inter", "n_union", ratio(F.col("n_inter"), F.col("n_union")).alias("ratio"), ratio(F.col("n_inter"), F.col("n_least")).alias("fract_min"))


def negate_parts(side: int) -> dict[str, str]:
    """Where each part goes when a side's query is negated."""
    flip = str.maketrans("xo", "ox")
    return {p: p[: side + 1] + p[side + 1].translate(flip) + p[side + 2 :] for p in PARTS}


def transition(op: str, side: int, holds: bool | None) -> dict[str, str]:
    """Where each part goes when a side's query is joined by op with a literal that is true, false or unknown."""
    stop = "x" if op == "or" else "o"
    mark = {True: "x", False: "o", None: "m"}[holds]

    def joined(now: str) -> str:
        if stop in (now, mark):
            return stop
        return "m" if "m" in (now, mark) else now

    return {p: p[: side + 1] + joined(p[side + 1]) + p[side + 2 :] for p in PARTS}


def supports_per_branch(df: DataFrame, node: Node) -> DataFrame:
    """branch, n: rows by the first of the query's branches that holds; -1 for none."""
    from ..expressions import Group, branches

    c = F.lit(-1)
    for i, b in reversed(list(enumerate(branches(node)))):
        c = F.when(to_column(Group("and", tuple(b))), F.lit(i)).otherwise(c)
    return df.groupBy(c.alias("branch")).agg(F.count("*").alias("n"))
