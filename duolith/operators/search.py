"""Search for literals: the best pairs of two columns, and the best extension of a redescription by a column.

What the search looks at are counts: of pairs of atoms of two columns, or of an
atom and the part that a row is in. An atom is a truth value, a category, or
one of the fine blocks that a numerical column is cut into once. The counts come
from one aggregate over the rows for all columns and redescriptions at hand; a
task then searches the counts of a pair of columns, or of a redescription and
a column, which are bounded by the atoms and don't grow with the rows.

The accuracy under any change is (i0 + sum of a) / (u0 + sum of b) over the
atoms taken, where a and b say by how many rows an atom, once taken, changes the
intersection and the union. That holds for both operators, for negated
literals and for all ways of counting missing values, since these only tell
which parts count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expressions import INF, Bool, Literal, Node, Num, to_column
from .align import BOOLEAN, CATEGORICAL, NUMERICAL
from .literals import best_run, category_literal
from .support import PARTS, TYPES, transition

#: Intervals are all tried where a column has so many atoms at most, and else found by running sums.
ALL_PAIRS = 400


@dataclass(frozen=True)
class Atoms:
    """A column's atoms in order. For numbers, the least and greatest value of each block."""

    var: str
    kind: int
    names: tuple[str, ...] = ()
    bounds: tuple[tuple[float, float], ...] = ()

    def __len__(self) -> int:
        return {BOOLEAN: 1, CATEGORICAL: len(self.names), NUMERICAL: len(self.bounds)}[self.kind]

    def literal(self, taken: Sequence[int], neg: bool = False) -> Literal | None:
        """The literal that holds for the atoms; none for all or no atoms."""
        if self.kind == BOOLEAN:
            return Bool(self.var, neg)
        if self.kind == CATEGORICAL:
            out = category_literal(self.var, [self.names[i] for i in taken], self.names, negation=not neg)
        else:
            first, last = min(taken), max(taken)
            low = -INF if first == 0 else self.bounds[first][0]
            high = INF if last == len(self.bounds) - 1 else self.bounds[last][1]
            out = None if low == -INF and high == INF else Num(self.var, low, high)
        return None if out is None else type(out)(**(vars(out) | {"neg": out.neg != neg}))


def columns_of(rows: DataFrame, kinds: dict[str, int], most: int, categories: int = 1000) -> list[Atoms]:
    """The atoms of the columns. Numbers with `most` distinct values at most have one for each, others blocks between `most` quantiles;
    columns with more than so many categories are left out, as are columns with one value or none. A few aggregates for all."""
    kinds = {c: k for c, k in kinds.items() if c in rows.columns}
    if not kinds:
        return []
    many = rows.agg(*(F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in kinds)).first()
    few = [c for c, k in kinds.items() if k == CATEGORICAL and many[c] <= 1.2 * categories or k == NUMERICAL and many[c] <= most]
    values = rows.agg(*(F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string" if kinds[c] == CATEGORICAL else "double"))).alias(c) for c in few)).first() if few else {}
    rest = [c for c, k in kinds.items() if k == NUMERICAL and c not in few]
    marks = [i / most for i in range(most)]
    cuts = rows.agg(*(F.percentile_approx(F.col(f"`{c}`").cast("double"), marks, 10 * most).alias(c) for c in rest)).first() if rest else {}
    lows = {c: sorted(set(cuts[c] or ())) for c in rest}
    ends = block_ends(rows, {c: v for c, v in lows.items() if len(v) > 1})
    out = []
    for c, k in kinds.items():
        if k == BOOLEAN:
            out.append(Atoms(c, k))
        elif k == CATEGORICAL and c in few and 1 < len(values[c]) <= categories:
            out.append(Atoms(c, k, tuple(values[c])))
        elif k == NUMERICAL and c in few and len(values[c]) > 1:
            out.append(Atoms(c, k, bounds=tuple((v, v) for v in values[c])))
        elif k == NUMERICAL and len(ends.get(c, ())) > 1:
            out.append(Atoms(c, k, bounds=tuple(ends[c])))
    return out


def block_ends(rows: DataFrame, lows: dict[str, list[float]]) -> dict[str, list[tuple[float, float]]]:
    """The least and greatest value of each block that the lower edges of a column make; blocks without values are left out."""
    if not lows:
        return {}
    cast = rows.select(*(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(lows)))
    names = [f"x{i}" for i in range(len(lows))]
    model = Bucketizer(inputCols=names, outputCols=[f"y{x}" for x in names], splitsArray=[[-INF, *v[1:], INF] for v in lows.values()], handleInvalid="keep")
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"yx{i}").alias("at"), F.col(x).alias("v")) for i, x in enumerate(names)))).alias("e")
    found = model.transform(cast).select(cells).where("e.v IS NOT NULL AND NOT isnan(e.v)").groupBy("e.i", "e.at").agg(F.min("e.v").alias("a"), F.max("e.v").alias("b"))
    out: dict[str, list[tuple[float, float]]] = {}
    columns = list(lows)
    for r in found.orderBy("i", "at").collect():  # the blocks of the columns
        out.setdefault(columns[r["i"]], []).append((r["a"], r["b"]))
    return out


def coded(rows: DataFrame, sides: Sequence[Sequence[Atoms]], rid: str) -> DataFrame:
    """rows with a column c{side}_{i} for each column of atoms: the number of the row's atom, null where the value is missing. A false
    Boolean is atom 1."""
    out = rows
    numbers: list[tuple[str, str, list[float]]] = []
    made: list[Column] = []
    for s, atoms in enumerate(sides):
        for i, a in enumerate(atoms):
            c = F.col(f"`{a.var}`")
            if a.kind == BOOLEAN:
                made.append(F.when(c, 0).when(~c, 1).cast("int").alias(f"c{s}_{i}"))
            elif a.kind == CATEGORICAL:
                made.append((F.array_position(F.array(*map(F.lit, a.names)), c.cast("string")) - 1).cast("int").alias(f"c{s}_{i}"))
            else:
                made.append(c.cast("double").alias(f"x{s}_{i}"))
                # a block begins at its least value
                numbers.append((f"x{s}_{i}", f"c{s}_{i}", [-INF, *(low for low, _ in a.bounds[1:]), INF]))
    out = out.select("*", *made)
    if numbers:
        model = Bucketizer(inputCols=[x for x, *_ in numbers], outputCols=[f"_{y}" for _, y, _ in numbers], splitsArray=[e for *_, e in numbers], handleInvalid="keep")
        out = model.transform(out)
        # values that are missing get a bucket of their own behind the others
        out = out.select("*", *(F.when(F.col(x).isNotNull() & ~F.isnan(x), F.col(f"_{y}")).cast("int").alias(y) for x, y, _ in numbers))
    return out.select(*rows.columns, *(f"c{s}_{i}" for s, atoms in enumerate(sides) for i in range(len(atoms))))


@dataclass(frozen=True)
class Bounds:
    """What a redescription must keep: rows in both, rows in neither, and what a literal must contribute."""

    min_in: int = 1
    min_out: int = 0
    min_contribution: int = 1


def sizes(counts: np.ndarray, names: Sequence[str]) -> np.ndarray:
    return sum((counts[..., PARTS.index(p)] for p in names), np.zeros(counts.shape[:-1], counts.dtype))


def best_extension(counts: np.ndarray, missing: np.ndarray, kind: int, side: int, op: str, neg: bool, parts_type: str, bounds: Bounds, multi: bool) -> tuple[float, list[int], np.ndarray] | None:
    """The accuracy, the atoms and the new counts of the parts of the best extension of a side by a column.

    counts: atoms by part; missing: of the rows without a value. The literal holds for the rows of the atoms, or with neg for the
    rows of the others; it is unknown for missing ones.
    """
    inter, diff = TYPES[parts_type]
    moved = {holds: np.array([PARTS.index(transition(op, side, holds)[p]) for p in PARTS]) for holds in (True, False, None)}

    def shifted(n: np.ndarray, holds: bool | None) -> np.ndarray:
        out = np.zeros_like(n)
        np.add.at(out.T, moved[holds], n.T)
        return out

    inside, outside = (shifted(counts, h) for h in ((False, True) if neg else (True, False)))
    rest = shifted(missing[None], None)[0]
    base = outside.sum(0) + rest  # no atom taken
    change = inside - outside
    a, b = sizes(change, inter), sizes(change, inter + diff)
    i0, u0, n = int(sizes(base, inter)), int(sizes(base, inter + diff)), int(base.sum())
    old = counts.sum(0) + missing
    old_i, old_u = int(sizes(old, inter)), int(sizes(old, inter + diff))

    def good(i: np.ndarray, u: np.ndarray) -> np.ndarray:
        gain = old_u - u if op == "and" else i - old_i
        return (i >= bounds.min_in) & (n - u >= bounds.min_out) & (gain >= bounds.min_contribution)

    def score(i, u):
        return np.where(np.asarray(u) > 0, np.asarray(i) / np.maximum(u, 1), 0.0)

    atoms = len(counts)
    found: list[tuple[float, list[int]]] = []
    if kind == NUMERICAL:
        if atoms <= ALL_PAIRS:
            s = [np.concatenate([[0], np.cumsum(x)]) for x in (a, b)]
            first, last = np.triu_indices(atoms)
            i, u = i0 + s[0][last + 1] - s[0][first], u0 + s[1][last + 1] - s[1][first]
            acc = np.where(good(i, u) & (last - first < atoms - 1), score(i, u), -1.0)
            k = int(np.lexsort((first, last - first, -acc))[0])
            if acc[k] >= 0:
                found.append((float(acc[k]), [int(first[k]), int(last[k])]))
        elif run := best_run(a, b, i0, u0):
            if run[1] - run[0] < atoms - 1:
                found.append((run[2], [run[0], run[1]]))
    else:
        single = score(i0 + a, u0 + b)
        ok = good(i0 + a, u0 + b)
        takable = atoms if kind == CATEGORICAL else 1
        found += [(float(single[k]), [k]) for k in range(takable) if ok[k]]
        if multi and kind == CATEGORICAL and atoms > 2:
            # the best set for a trial accuracy takes every category that adds more than its share; its accuracy is the next trial
            trial, taken = max((x[0] for x in found), default=0.0), None
            while True:
                new = [k for k in range(atoms) if a[k] - trial * b[k] > 0]
                acc = float(score(i0 + a[new].sum(), u0 + b[new].sum()))
                if not new or acc <= trial + 1e-12:
                    break
                trial, taken = acc, new
            if taken and len(taken) < atoms and good(np.array(i0 + a[taken].sum()), np.array(u0 + b[taken].sum())):
                found.append((trial, taken))
    if not found:
        return None
    acc, taken = max(found, key=lambda x: (x[0], -len(x[1]), [-t for t in x[1]]))
    every = list(range(taken[0], taken[1] + 1)) if kind == NUMERICAL else taken
    new = base + change[every].sum(0)
    i, u = sizes(new, inter), sizes(new, inter + diff)
    return (float(score(i, u)), taken, new) if bool(good(i, u)) else None


def extension_counts(data: DataFrame, items: Sequence[tuple[Node, Node]], wanted: Sequence[tuple[int, int, int]]) -> DataFrame:
    """item, side, col, atom, part, n for the wanted (item, side, column). data: of coded."""
    code = lambda c: F.when(c, 0).when(~c, 1).otherwise(2)
    said = data.select(*(c for c in data.columns if c.startswith(("c0_", "c1_"))), *((3 * code(to_column(l)) + code(to_column(r))).alias(f"p{i}") for i, (l, r) in enumerate(items)))
    marks = F.array(*(F.struct(F.lit(i).alias("item"), F.lit(s).alias("side"), F.lit(k).alias("col"), F.coalesce(F.col(f"c{s}_{k}"), F.lit(-1)).alias("atom"), F.col(f"p{i}").alias("part")) for i, s, k in wanted))
    return said.select(F.explode(marks).alias("m")).groupBy("m.item", "m.side", "m.col", "m.atom", "m.part").agg(F.count("*").alias("n"))


FOUND = "item int, side int, col int, op string, neg boolean, acc double, taken array<int>, counts array<long>"
_NUMBER = np.array([PARTS.index(f"E{a}{b}") for a in "xom" for b in "xom"])


def table_of(pdf: pd.DataFrame, atoms: int) -> np.ndarray:
    """Atoms by part, the last row for missing values."""
    out = np.zeros((atoms + 1, len(PARTS)), np.int64)
    np.add.at(out, (pdf["atom"].to_numpy(), _NUMBER[pdf["part"].to_numpy()]), pdf["n"].to_numpy())
    return out


def extensions(data: DataFrame, sides: Sequence[Sequence[Atoms]], items: Sequence[tuple[Node, Node]], ways: dict[tuple[int, int], Sequence[tuple[str, bool]]], wanted: Sequence[tuple[int, int, int]], parts_type: str, bounds: Bounds, multi: bool) -> DataFrame:
    """The best extension of each wanted (item, side, column) by each of the ways (operator, negated) of its item and side."""
    shape = {(s, k): (len(a), a.kind) for s, atoms in enumerate(sides) for k, a in enumerate(atoms)}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        item, side, col = (int(pdf[c].iloc[0]) for c in ("item", "side", "col"))
        n, kind = shape[side, col]
        table = table_of(pdf, 2 if kind == BOOLEAN else n)
        out = []
        for op, neg in ways[item, side]:
            if hit := best_extension(table[:-1], table[-1], kind, side, op, neg, parts_type, bounds, multi):
                out.append((item, side, col, op, neg, hit[0], hit[1], hit[2].tolist()))
        return pd.DataFrame(out, columns=["item", "side", "col", "op", "neg", "acc", "taken", "counts"])

    return extension_counts(data, items, wanted).groupBy("item", "side", "col").applyInPandas(one, FOUND)


# Initial pairs.
def pair_counts(data: DataFrame, wanted: Sequence[tuple[int, int]]) -> DataFrame:
    """left, right, l, r, n: how often atom l of a left column meets atom r of a right one; missing values are -1."""
    at = lambda s, k: F.coalesce(F.col(f"c{s}_{k}"), F.lit(-1))
    marks = F.array(*(F.struct(F.lit(i).alias("left"), F.lit(j).alias("right"), at(0, i).alias("l"), at(1, j).alias("r")) for i, j in wanted))
    return data.select(F.explode(marks).alias("m")).groupBy("m.left", "m.right", "m.l", "m.r").agg(F.count("*").alias("n"))


PAIR = "left int, right int, acc double, taken_l array<int>, taken_r array<int>, counts array<long>"


def choices(kind: int, atoms: int) -> list[tuple[int, int]]:
    """First and last atom of what a literal may take to begin with: a truth, one category, any interval but the whole."""
    if kind == NUMERICAL:
        return [(i, j) for i in range(atoms) for j in range(i, atoms) if j - i < atoms - 1]
    return [(i, i) for i in range(1 if kind == BOOLEAN else atoms)]


def part_table(m: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The counts of the parts for masks of atoms. m: left by right atoms, with a last row and column for missing values."""
    rows = np.stack([l, ~l, np.zeros_like(l)]), np.stack([r, ~r, np.zeros_like(r)])
    a, b = (np.pad(x, ((0, 0), (0, 1))) for x in rows)
    a[2, -1] = b[2, -1] = True
    out = np.empty(len(PARTS), np.int64)
    out[_NUMBER] = (a.astype(np.int64) @ m @ b.astype(np.int64).T).ravel()
    return out


def best_pairs_of(m: np.ndarray, kind_l: int, kind_r: int, parts_type: str, bounds: Bounds, least: float, productivity: str, multi: bool, most: int) -> list[tuple[float, list[int], list[int], np.ndarray]]:
    """The best pairs of literals on two columns that aren't too alike, by their contingency table: accuracy, atoms, atoms, counts."""
    inter, diff = TYPES[parts_type]
    cl, cr = choices(kind_l, m.shape[0] - 1), choices(kind_r, m.shape[1] - 1)
    if not cl or not cr:
        return []
    (l0, l1), (r0, r1) = np.array(cl).T, np.array(cr).T
    # by two prefix sums: the rows of each pair of choices, and of each choice with each state of the other side
    upto = np.pad(m[:-1].cumsum(0), ((1, 0), (0, 0)))
    rows = upto[l1 + 1] - upto[l0]  # choice by right atom
    state = np.stack([rows[:, :-1].sum(1), rows[:, -1]], 1)
    total = np.stack([m[:, :-1].sum(1), m[:, -1]], 1)  # of all left atoms, by known and missing on the right
    across = np.pad(rows[:, :-1].cumsum(1), ((0, 0), (1, 0)))
    xx = across[:, r1 + 1] - across[:, r0]
    columns = np.pad(m[:, :-1].cumsum(1), ((0, 0), (1, 0)))
    picked = columns[:, r1 + 1] - columns[:, r0]  # left atom by choice, the last row for missing
    known_l, miss_l = picked[:-1].sum(0), picked[-1]
    whole = m[:-1, :-1].sum()
    xo = state[:, :1] - xx
    ox = known_l[None] - xx
    parts = {
        "Exx": xx, "Exo": xo, "Eox": ox, "Eoo": whole - xx - xo - ox,
        "Exm": np.broadcast_to(state[:, 1:], xx.shape), "Eom": np.broadcast_to(total[:-1, 1].sum() - state[:, 1:], xx.shape),
        "Emx": np.broadcast_to(miss_l[None], xx.shape), "Emo": np.broadcast_to(m[-1, :-1].sum() - miss_l[None], xx.shape), "Emm": np.broadcast_to(m[-1, -1], xx.shape),
    }
    add = lambda names: sum((parts[p] for p in names), np.zeros(xx.shape, np.int64))
    i, u = add(inter), add(inter + diff)
    acc = np.where((i >= bounds.min_in) & (m.sum() - u >= bounds.min_out) & (u > 0), i / np.maximum(u, 1), -1.0)
    out: list[tuple[float, list[int], list[int], np.ndarray]] = []
    while len(out) < most:
        k = int(acc.argmax())
        x, y = divmod(k, acc.shape[1])
        if acc[x, y] < max(least, 0.0):
            break
        score, taken_l, taken_r = float(acc[x, y]), [int(l0[x]), int(l1[x])], [int(r0[y]), int(r1[y])]
        near_l, near_r = (l0 <= l1[x]) & (l1 >= l0[x]), (r0 <= r1[y]) & (r1 >= r0[y])
        mask_l, mask_r = (np.isin(np.arange(s - 1), np.arange(t[0], t[1] + 1)) for s, t in ((m.shape[0], taken_l), (m.shape[1], taken_r)))
        if multi and CATEGORICAL in (kind_l, kind_r):
            score, mask_l, mask_r = with_more_categories(m, mask_l, mask_r, kind_l, kind_r, inter, diff, bounds, score)
        take = lambda kind, mask, taken: [int(t) for t in np.flatnonzero(mask)] if kind != NUMERICAL else taken
        out.append((score, take(kind_l, mask_l, taken_l), take(kind_r, mask_r, taken_r), part_table(m, mask_l, mask_r)))
        if productivity == "low":
            break
        alike = {"medium": near_l[:, None] | near_r[None], "high": near_l[:, None] & near_r[None], "extra": np.zeros(acc.shape, bool)}[productivity]
        acc = np.where(alike, -1.0, acc)
        acc[x, y] = -1.0
    return out


def with_more_categories(m: np.ndarray, l: np.ndarray, r: np.ndarray, kind_l: int, kind_r: int, inter: Sequence[str], diff: Sequence[str], bounds: Bounds, score: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Categories are joined by or, one at a time, as long as one raises the accuracy."""

    def accuracy(l: np.ndarray, r: np.ndarray) -> float:
        counts = part_table(m, l, r)
        i, u = int(sizes(counts, inter)), int(sizes(counts, inter + diff))
        return i / u if u and i >= bounds.min_in and counts.sum() - u >= bounds.min_out else -1.0

    while True:
        steps = []
        for side, kind, mask in ((0, kind_l, l), (1, kind_r, r)):
            if kind == CATEGORICAL and mask.sum() < len(mask) - 1:
                for k in np.flatnonzero(~mask):
                    new = mask.copy()
                    new[k] = True
                    steps.append((accuracy(new, r) if side == 0 else accuracy(l, new), -side, -int(k), new))
        best = max(steps, key=lambda s: s[:3], default=None)
        if best is None or best[0] <= score + 1e-12:
            return score, l, r
        score = best[0]
        l, r = (best[3], r) if best[1] == 0 else (l, best[3])


def pairs(data: DataFrame, sides: Sequence[Sequence[Atoms]], wanted: Sequence[tuple[int, int]], parts_type: str, bounds: Bounds, least: float, productivity: str, multi: bool, most: int) -> DataFrame:
    """The best pairs of literals of each wanted pair of columns."""
    shape = [[(2 if a.kind == BOOLEAN else len(a), a.kind) for a in atoms] for atoms in sides]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = int(pdf["left"].iloc[0]), int(pdf["right"].iloc[0])
        (n_l, kind_l), (n_r, kind_r) = shape[0][left], shape[1][right]
        m = np.zeros((n_l + 1, n_r + 1), np.int64)
        m[pdf["l"].to_numpy(), pdf["r"].to_numpy()] = pdf["n"].to_numpy()  # -1, missing, is the last
        found = best_pairs_of(m, kind_l, kind_r, parts_type, bounds, least, productivity, multi, most)
        return pd.DataFrame([(left, right, acc, l, r, counts.tolist()) for acc, l, r, counts in found], columns=["left", "right", "acc", "taken_l", "taken_r", "counts"])

    return pair_counts(data, wanted).groupBy("left", "right").applyInPandas(one, PAIR)
