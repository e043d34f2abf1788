"""Redescriptions from decision trees that are fit to one side by turns, each to what the other one's query says.

cartwheel fits full trees by turns until the accuracy stands still, sprit lets
the depth grow from 2, split from its start on both sides, and layered grows
trees leaf by leaf on alternate sides, a layer of all leaves in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expressions import INF, Bool, Group, Literal, Node, Num, literals, normalize, to_column
from ..functions.settle import settled
from .align import BOOLEAN, NUMERICAL
from .search import Atoms, coded, columns_of
from .support import evaluate


def fit_tree(df: DataFrame, columns: Sequence[str], target: Node, *, depth: int, min_leaf: int = 1, impurity: str = "gini", seed: int = 0, flags: frozenset[str] = frozenset()) -> Node | None:
    """The query of the leaves that say the target holds: an or of the paths to them; none if there is no such leaf.

    Rows where a column or the target is unknown are left out. flags: the Boolean columns.
    """
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns), to_column(target).cast("double").alias("_target")).na.drop()
    data = VectorAssembler(inputCols=list(columns), outputCol="_features").transform(rows)
    if len(data.select("_target").distinct().head(2)) < 2:
        return None
    model = DecisionTreeClassifier(labelCol="_target", featuresCol="_features", maxDepth=depth, minInstancesPerNode=min_leaf, impurity=impurity, seed=seed).fit(data)
    found: list[Node] = []

    def walk(node, box: dict[str, tuple[float, float]]) -> None:
        if node.getClass().getSimpleName() == "InternalNode":
            name, at = columns[node.split().featureIndex()], node.split().threshold()
            low, high = box.get(name, (-INF, INF))
            walk(node.leftChild(), box | {name: (low, min(high, at))})
            walk(node.rightChild(), box | {name: (max(low, at), high)})
        elif node.prediction() == 1.0 and box:
            found.append(path(box, flags))

    walk(model._call_java("rootNode"), {})
    return None if not found else (found[0] if len(found) == 1 else Group("or", tuple(found)))


def path(box: dict[str, tuple[float, float]], flags: frozenset[str]) -> Node:
    """A conjunction of literals; a split is value <= threshold, so a lower bound, which is closed, becomes the complement of an upper one."""
    parts: list[Literal] = []
    for name, (low, high) in sorted(box.items()):
        if name in flags:
            parts.append(Bool(name, neg=low == -INF))
        else:
            parts += ([Num(name, -INF, low, neg=True)] if low > -INF else []) + ([Num(name, -INF, high)] if high < INF else [])
    return parts[0] if len(parts) == 1 else Group("and", tuple(parts))


def pick_step(accuracies: Sequence[float], min_gain: float = 0.01) -> int:
    """The earliest step within min_gain of the best."""
    return next(i for i, a in enumerate(accuracies) if a >= max(accuracies) - min_gain)


def alternate(df: DataFrame, start: Node, columns: tuple[Sequence[str], Sequence[str]], *, method: str = "cartwheel", depth: int = 3, rounds: int = 10, min_leaf: int = 1, min_gain: float = 0.01, flags: frozenset[str] = frozenset(), side: int = 1) -> list[tuple[tuple[Node, Node], float]]:
    """The redescriptions found on the way, with their accuracies; the last is the one picked. start: a query of the side before `side`."""
    if method == "layered":
        kinds = tuple({c: BOOLEAN if c in flags else NUMERICAL for c in side_columns} for side_columns in columns)
        steps = layered(df, start, kinds, depth=depth, min_leaf=min_leaf, side=side)
        return [*steps, steps[pick_step([a for _, a in steps], min_gain)]] if steps else []
    queries: list[Node | None] = [None, None]
    queries[1 - side] = start
    steps: list[tuple[tuple[Node, Node], float]] = []
    now = side
    for step in range(rounds):
        at = {"cartwheel": depth, "sprit": min(2 + step // 2, depth), "split": min(1 + step // 2, depth)}[method]
        new = fit_tree(df, columns[now], queries[1 - now], depth=at, min_leaf=min_leaf, flags=flags)
        if new is None:
            break
        new = normalize(new, 8)
        same = new == queries[now]
        queries[now] = new
        if all(q is not None for q in queries):
            steps.append(((queries[0], queries[1]), evaluate(df, [(queries[0], queries[1])]).first()["acc"]))
        if same and at >= depth:
            break
        now = 1 - now
    if steps:
        steps.append(steps[pick_step([a for _, a in steps], min_gain)])
    return steps


@dataclass(frozen=True)
class Leaf:
    """A leaf of a tree that grows: the literals on the way to it, how many rows it has and for how many of them the target holds."""

    path: tuple[Literal, ...] = ()
    n: int = 0
    hits: int = 0

    @property
    def holds(self) -> bool:
        return 2 * self.hits > self.n


def impurity_of(n: np.ndarray, hits: np.ndarray, how: str) -> np.ndarray:
    """Of so many rows, times their number."""
    p = np.divide(hits, n, out=np.zeros(np.shape(n)), where=np.asarray(n) > 0)
    if how == "gini":
        return 2 * n * p * (1 - p)
    return -n * sum(np.where(q > 0, q * np.log2(np.where(q > 0, q, 1)), 0) for q in (p, 1 - p))


def best_split(atoms: Atoms, n: np.ndarray, hits: np.ndarray, min_leaf: int, impurity: str) -> tuple[float, Literal, tuple[int, int], tuple[int, int]] | None:
    """The gain, the literal, and rows and hits where it holds and where it doesn't, of the best split of a leaf by a column. n, hits: by atom."""
    total, whole = int(n.sum()), int(hits.sum())
    if atoms.kind == NUMERICAL:
        left_n, left_hits = np.cumsum(n)[:-1], np.cumsum(hits)[:-1]
    else:
        left_n, left_hits = (n[:1], hits[:1]) if atoms.kind == BOOLEAN else (n, hits)
    ok = (left_n >= min_leaf) & (total - left_n >= min_leaf)
    if not ok.any():
        return None
    gain = impurity_of(np.array([total]), np.array([whole]), impurity) - impurity_of(left_n, left_hits, impurity) - impurity_of(total - left_n, whole - left_hits, impurity)
    k = int(np.argmax(np.where(ok, gain, -np.inf)))
    literal = Num(atoms.var, -INF, atoms.bounds[k][1]) if atoms.kind == NUMERICAL else atoms.literal([k])
    if literal is None:
        return None
    inside = int(left_n[k]), int(left_hits[k])
    return float(gain[k]), literal, inside, (total - inside[0], whole - inside[1])


def next_layer(rows: DataFrame, atoms: Sequence[Atoms], leaves: Sequence[Leaf], target: Node, side: int, *, min_leaf: int, impurity: str = "gini") -> list[Leaf]:
    """Each leaf split in two by the column and the cut that tell best where the target holds, or left as it is.

    All leaves and columns are counted in one job; rows: of search.coded. Two halves that say the same are one leaf again.
    """
    at = F.coalesce(*(F.when(to_column(Group("and", leaf.path)), F.lit(i)) for i, leaf in enumerate(leaves)))
    marks = F.array(*(F.struct(F.lit(k).alias("col"), F.col(f"c{side}_{k}").alias("atom")) for k in range(len(atoms))))
    seen = rows.select(at.alias("leaf"), to_column(target).alias("hit"), F.explode(marks).alias("m")).where("leaf IS NOT NULL AND hit IS NOT NULL AND m.atom IS NOT NULL")
    counts = seen.groupBy("leaf", "m.col", "m.atom").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).collect()  # leaves by atoms of the columns
    tables: dict[tuple[int, int], np.ndarray] = {}
    for r in counts:
        size = 2 if atoms[r["col"]].kind == BOOLEAN else len(atoms[r["col"]])
        tables.setdefault((r["leaf"], r["col"]), np.zeros((size, 2), np.int64))[r["atom"]] = r["n"], r["hits"]
    out: list[Leaf] = []
    for i, leaf in enumerate(leaves):
        splits = [(*s, k) for k, a in enumerate(atoms) if (i, k) in tables and (s := best_split(a, tables[i, k][:, 0], tables[i, k][:, 1], min_leaf, impurity))]
        gain, literal, inside, outside, _ = max(splits, key=lambda s: (s[0], -s[4]), default=(0.0, None, (0, 0), (0, 0), 0))
        whole = Leaf(leaf.path, inside[0] + outside[0], inside[1] + outside[1]) if literal is not None else leaf
        if gain <= 1e-9 * max(whole.n, 1):
            out.append(whole)
            continue
        halves = [Leaf((*leaf.path, x), *c) for x, c in ((literal, inside), (replace(literal, neg=not literal.neg), outside))]
        out += halves
    return out


def pruned_leaves(leaves: Sequence[Leaf]) -> list[Leaf]:
    """Two halves of one leaf that say the same become that leaf, as often as there are such."""
    out = list(leaves)
    while True:
        for a, b in zip(out, out[1:]):
            if a.path and b.path and a.path[:-1] == b.path[:-1] and a.path[-1] == replace(b.path[-1], neg=not b.path[-1].neg) and a.holds == b.holds:
                i = out.index(a)
                out[i : i + 2] = [Leaf(a.path[:-1], a.n + b.n, a.hits + b.hits)]
                break
        else:
            return out


def query_of(leaves: Sequence[Leaf]) -> Node | None:
    """What the leaves say for which the target holds; none if they all say the same."""
    found = [leaf for leaf in leaves if leaf.holds]
    if not found or len(found) == len(leaves):
        return None
    parts = [leaf.path[0] if len(leaf.path) == 1 else Group("and", leaf.path) for leaf in found]
    return parts[0] if len(parts) == 1 else Group("or", tuple(parts))


def layered(df: DataFrame, start: Node, kinds: tuple[dict[str, int], dict[str, int]], *, depth: int = 3, min_leaf: int = 1, impurity: str = "gini", side: int = 1, cuts: int = 200, rid: str = "rid") -> list[tuple[tuple[Node, Node], float]]:
    """Trees on both sides that grow by a layer in turn, each layer grafted on the leaves of the last one and fit to what the other side's
    tree says by then. The redescriptions on the way, with their accuracies."""
    sides = [columns_of(df, k, cuts) for k in kinds]
    rows = settled(coded(df, sides, rid))
    leaves: list[list[Leaf]] = [[Leaf()], [Leaf()]]
    queries: list[Node | None] = [None, None]
    queries[1 - side] = start
    steps: list[tuple[tuple[Node, Node], float]] = []
    for _ in range(depth):
        changed = False
        for now in (side, 1 - side):
            if not sides[now]:
                continue
            leaves[now] = next_layer(rows, sides[now], leaves[now], queries[1 - now], now, min_leaf=min_leaf, impurity=impurity)
            new = query_of(pruned_leaves(leaves[now]))
            if new is None:
                return steps
            new = normalize(new, 8)
            changed |= new != queries[now]
            queries[now] = new
            steps.append(((queries[0], queries[1]), evaluate(rows, [(queries[0], queries[1])]).first()["acc"]))
        if not changed:
            break
    return steps


def used_columns(queries: tuple[Node, Node]) -> set[str]:
    return {x.var for q in queries for x in literals(q) if hasattr(x, "var")}
