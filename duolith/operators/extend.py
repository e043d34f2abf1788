"""Extension, pruning and conditions of a redescription, scored from counts of part and literal.

Since a query joined by an operator with a literal has the support that the
operator gives of the two, one aggregate of part by column value is all that
the accuracies of every extension by that column need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expressions import Group, Literal, Node, extend, literals, minus_one, push_negation, show, to_column
from .support import PARTS, TYPES, evaluate, part, ratio, total, transition


def literal_parts(df: DataFrame, left: Node, right: Node, candidates: Sequence[Literal]) -> DataFrame:
    """lit (the number of the candidate), part, n_true, n_false, n_missing; one pass over the rows for all candidates."""
    name = part(to_column(left), to_column(right)).alias("part")
    cols = [to_column(c) for c in candidates]
    sums = [f(c).alias(f"{i}_{k}") for i, c in enumerate(cols) for k, f in (("t", F.count_if), ("f", lambda c: F.count_if(~c)), ("m", lambda c: F.count_if(c.isNull())))]
    wide = df.groupBy(name).agg(*sums)
    rows = [F.struct(F.lit(i).alias("lit"), F.col(f"{i}_t").alias("n_true"), F.col(f"{i}_f").alias("n_false"), F.col(f"{i}_m").alias("n_missing")) for i in range(len(cols))]
    return wide.select("part", F.explode(F.array(*rows)).alias("r")).select("r.lit", "part", "r.n_true", "r.n_false", "r.n_missing")


def literal_parts_of(df: DataFrame, pairs: Sequence[tuple[Node, Node]], candidates: Sequence[Literal]) -> DataFrame:
    """item, lit, part, n_true, n_false, n_missing: literal_parts for several redescriptions in one pass over the rows."""
    cols = [to_column(c) for c in candidates]
    names = F.array(*(F.struct(F.lit(i).alias("item"), part(to_column(l), to_column(r)).alias("part")) for i, (l, r) in enumerate(pairs)))
    marked = df.select(*(c.alias(f"v{i}") for i, c in enumerate(cols)), F.explode(names).alias("p"))
    sums = [f(F.col(f"v{i}")).alias(f"{i}_{k}") for i in range(len(cols)) for k, f in (("t", F.count_if), ("f", lambda c: F.count_if(~c)), ("m", lambda c: F.count_if(c.isNull())))]
    wide = marked.groupBy("p.item", "p.part").agg(*sums)
    rows = [F.struct(F.lit(i).alias("lit"), F.col(f"{i}_t").alias("n_true"), F.col(f"{i}_f").alias("n_false"), F.col(f"{i}_m").alias("n_missing")) for i in range(len(cols))]
    return wide.select("item", "part", F.explode(F.array(*rows)).alias("r")).select("item", "r.lit", "part", "r.n_true", "r.n_false", "r.n_missing")


def joined(items: Sequence[Node], op: str = "and") -> Node:
    """The items as one query."""
    return items[0] if len(items) == 1 else Group(op, tuple(items))


def moved_counts(op: str, side: int, neg: bool) -> list[Column]:
    """Aggregates over rows of literal_parts for one literal: the counts of the parts after joining it (negated if neg) by op to a side."""
    true, false = ("n_false", "n_true") if neg else ("n_true", "n_false")
    out = []
    for name in PARTS:
        got = F.lit(0).cast("long")
        for holds, column in ((True, true), (False, false), (None, "n_missing")):
            sources = [p for p, q in transition(op, side, holds).items() if q == name]
            got = got + F.when(F.col("part").isin(*sources), F.col(column)).otherwise(0)
        out.append(F.sum(got).alias(name))
    return out


def score_extensions(parts: DataFrame, side: int, *, ops: Sequence[str] = ("and", "or"), negations: Sequence[bool] = (False, True), kind: str = "none", min_in: int = 1, min_out: int = 0, min_contribution: int = 1) -> DataFrame:
    """lit, op, neg, the counts of the parts, acc and contribution of each extension within the bounds. parts: of literal_parts.

    The contribution is how many rows the literal takes from the union (and) or adds to the intersection (or).
    """
    inter, diff = TYPES[kind]
    ways = [(op, neg) for op in ops for neg in negations]
    every = F.col("n_true") + F.col("n_false") + F.col("n_missing")
    before = [F.sum(F.when(F.col("part").isin(*names), every).otherwise(0)).alias(k) for k, names in (("old_i", inter), ("old_u", inter + diff))]
    # all ways at once, so that the rows are read once
    wide = parts.groupBy("lit").agg(*before, *(F.struct(*moved_counts(op, side, neg)).alias(f"w{k}") for k, (op, neg) in enumerate(ways)))
    stacked = F.array(*(F.struct(F.lit(op).alias("op"), F.lit(neg).alias("neg"), *(F.col(f"w{k}.{p}").alias(p) for p in PARTS)) for k, (op, neg) in enumerate(ways)))
    scored = wide.select("lit", "old_i", "old_u", F.explode(stacked).alias("w")).select("lit", "old_i", "old_u", "w.*")
    i, u = total(inter), total(inter) + total(diff)
    gain = F.when(F.col("op") == "and", F.col("old_u") - u).otherwise(i - F.col("old_i"))
    everything = total(PARTS)
    out = scored.withColumn("acc", ratio(i, u)).withColumn("contribution", gain)
    return out.where((i >= min_in) & (everything - u >= min_out) & (F.col("contribution") >= min_contribution)).drop("old_i", "old_u")


def score_rows(rows: Sequence, side: int, *, ops: Sequence[str] = ("and", "or"), negations: Sequence[bool] = (False, True), kind: str = "none", min_in: int = 1, min_out: int = 0, min_contribution: int = 1) -> list[dict]:
    """score_extensions on the driver, from the collected rows of literal_parts: nine for each candidate at most."""
    inter, diff = TYPES[kind]
    table: dict[int, dict[str, tuple[int, int, int]]] = {}
    for r in rows:
        table.setdefault(r["lit"], {})[r["part"]] = (r["n_true"], r["n_false"], r["n_missing"])
    moves = {(op, holds): transition(op, side, holds) for op in ops for holds in (True, False, None)}
    size = lambda counts, names: sum(counts.get(p, 0) for p in names)
    out = []
    for lit, parts in sorted(table.items()):
        old = {p: sum(n) for p, n in parts.items()}
        for op in ops:
            for neg in negations:
                new = dict.fromkeys(PARTS, 0)
                for p, (true, false, missing) in parts.items():
                    for holds, n in ((True, false if neg else true), (False, true if neg else false), (None, missing)):
                        new[moves[op, holds][p]] += n
                i, u = size(new, inter), size(new, inter + diff)
                gain = size(old, inter + diff) - u if op == "and" else i - size(old, inter)
                if i >= min_in and sum(new.values()) - u >= min_out and gain >= min_contribution:
                    out.append(new | {"lit": lit, "op": op, "neg": neg, "acc": i / u if u else (float("inf") if i else 0.0), "contribution": gain})
    return out


def weighted_score(acc: Column, base: float, pval: Column | None = None, *, impacc: float = 1.0, rel_impacc: float = 0.0, max_pval: float = 0.0, penalty: float = 0.0) -> Column:
    """Gain in accuracy, absolute and relative, less a penalty: a fixed one above max_pval if that is positive, or its size times the p-value."""
    gain = acc - base
    score = F.lit(impacc) * gain + F.lit(rel_impacc) * (gain / base if base else acc)
    if pval is None or not max_pval:
        return score
    return score + (F.lit(max_pval) * pval if max_pval < 0 else -F.lit(penalty) * (pval > max_pval).cast("double"))


def apply_extension(queries: tuple[Node, Node], side: int, op: str, literal: Literal, neg: bool) -> tuple[Node, Node]:
    from dataclasses import replace

    new = extend(queries[side], op, replace(literal, neg=literal.neg != neg))
    return (new, queries[1]) if side == 0 else (queries[0], new)


def minus_one_variants(queries: tuple[Node, Node]) -> list[tuple[Node, Node]]:
    return [(q, queries[1]) for q in minus_one(queries[0])] + [(queries[0], q) for q in minus_one(queries[1])]


def prune(df: DataFrame, queries: tuple[Node, Node], kind: str = "none") -> tuple[Node, Node]:
    """Leave out a literal as long as the accuracy rises; all queries with one literal less are counted in one pass."""

    while variants := minus_one_variants(queries):
        rows = {r["pair"]: r["acc"] for r in evaluate(df, [queries, *variants], kind).collect()}
        best = max(range(1, len(variants) + 1), key=lambda i: rows[i])
        if rows[best] <= rows[0]:
            break
        queries = variants[best - 1]
    return queries


def improve(df: DataFrame, queries: tuple[Node, Node], candidates: tuple[Sequence[Literal], Sequence[Literal]], kind: str = "none", min_gain: float = 0.0) -> tuple[Node, Node]:
    """Replace or leave out a literal as long as the accuracy rises by more than min_gain; all single changes are counted in one pass."""
    from ..expressions import map_literals

    while True:
        variants = minus_one_variants(queries)
        for side in (0, 1):
            old = list(literals(queries[side]))
            for k in range(len(old)):
                for c in candidates[side]:
                    if c.var == getattr(old[k], "var", None) or c.var not in {getattr(x, "var", None) for x in old}:
                        n = iter(range(len(old)))
                        new = map_literals(queries[side], lambda x: c if next(n) == k else x)  # noqa: B023
                        variants.append((new, queries[1]) if side == 0 else (queries[0], new))
        variants = [v for v in dict.fromkeys(variants) if v != queries]
        if not variants:
            return queries
        rows = {r["pair"]: r["acc"] for r in evaluate(df, [queries, *variants], kind).collect()}
        best = max(range(1, len(variants) + 1), key=lambda i: (rows[i], -i))
        if rows[best] <= rows[0] + min_gain:
            return queries
        queries = variants[best - 1]


def fill_anonymous(df: DataFrame, queries: tuple[Node, Node], candidates: tuple[Sequence[Literal], Sequence[Literal]], kind: str = "none") -> tuple[Node, Node]:
    """Put the literal of highest accuracy in each anonymous place, one after the other; places without a candidate are left out."""
    from ..expressions import Anon, fill, minus_anon

    for side in (0, 1):
        for hole in [x for x in literals(queries[side]) if isinstance(x, Anon)]:
            fits = [c for c in candidates[side] if c.var == hole.var]
            if not fits:
                continue
            filled = [fill(queries[side], hole.var, c) for c in fits]
            pairs = [tuple(minus_anon(q) for q in ((f, queries[1]) if side == 0 else (queries[0], f))) for f in filled]
            rows = {r["pair"]: r["acc"] for r in evaluate(df, pairs, kind).collect()}
            best = filled[max(rows, key=lambda i: (rows[i], -i))]
            queries = (best, queries[1]) if side == 0 else (queries[0], best)
    return minus_anon(queries[0]), minus_anon(queries[1])


def conditioned(df: DataFrame, queries: tuple[Node, Node], conditions: Sequence[Node]) -> DataFrame:
    """cond, n_inter, n_union, acc of the pair over the rows where each condition holds."""
    l, r = (to_column(q) for q in queries)
    sums = [f.alias(f"{i}_{k}") for i, c in enumerate(conditions) for k, f in (("i", F.count_if(l & r & to_column(c))), ("u", F.count_if((l | r) & to_column(c))))]
    rows = [F.struct(F.lit(i).alias("cond"), F.col(f"{i}_i").alias("n_inter"), F.col(f"{i}_u").alias("n_union")) for i in range(len(conditions))]
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("acc", ratio(F.col("n_inter"), F.col("n_union")))


def find_condition(df: DataFrame, queries: tuple[Node, Node], candidates: Sequence[Literal], min_in: int = 1) -> tuple[Node | None, float]:
    """A conjunction of literals under which the accuracy is highest, grown greedily; none if no literal raises it."""

    base = evaluate(df, [queries]).first()["acc"]
    best: Node | None = None
    while True:
        grown = [c if best is None else extend(best, "and", c) for c in candidates if best is None or c.var not in {x.var for x in literals(best)}]
        rows = conditioned(df, queries, grown).where(F.col("n_inter") >= min_in).orderBy(F.desc("acc"), "cond").limit(1).collect() if grown else []
        if not rows or rows[0]["acc"] <= base:
            return best, base
        best, base = grown[rows[0]["cond"]], rows[0]["acc"]


def canonical(queries: tuple[Node, Node]) -> tuple[str, str]:
    """What two redescriptions of equal meaning by order and nesting have in common; the key of the seen ones."""
    from ..expressions import ordered

    return show(ordered(queries[0])), show(ordered(queries[1]))


class Seen:
    """The redescriptions that were explored, by canonical key."""

    def __init__(self):
        self.keys: set[tuple[str, str]] = set()

    def add(self, queries: tuple[Node, Node]) -> bool:
        """Whether it is new."""
        key = canonical(queries)
        new = key not in self.keys
        self.keys.add(key)
        return new


def allowed_ops(query: Node, other: Node, ops: Sequence[str] = ("and", "or"), single_side_or: bool = False) -> tuple[str, ...]:
    """The operators by which a side may be extended: or only for a lone literal's first step if the other side's has or already."""
    has_or = lambda q: isinstance(q, Group) and (q.op == "or" or any(map(has_or, q.items)))
    return tuple(op for op in ops if not (op == "or" and single_side_or and has_or(push_negation(other))))
