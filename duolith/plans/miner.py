"""Mining runs: initial pairs, expansion, selection.

The loops are on the driver over few redescriptions; rows are counted in jobs,
one for all pairs of columns and one for each generation. Given the kinds of the
columns, literals are searched for in the data: intervals and sets of
categories are chosen for the pair or the redescription at hand. Given literals
only, these are combined as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expressions import Bool, Cat, Literal, Node, length, literals, map_literals, show, to_column
from ..functions.settle import settled
from ..operators import extend as X
from ..operators import itemsets as I
from ..operators import literals as L
from ..operators import lsh as H
from ..operators import pairs as P
from ..operators import search as Q
from ..operators import select as S
from ..operators import trees as T
from ..operators.align import BOOLEAN, CATEGORICAL, NUMERICAL
from ..operators.support import PARTS, evaluate, measured

#: Row numbers of that size and more are hashed below it, a prime, before MinHash.
WIDE = 2_147_483_647

#: What some parameters may be.
CHOICES = {
    "mining_algo": ("greedy", "itemsets", "cartwheel", "sprit", "split", "layered"),
    "pair_sel": ("overall", "alternate", "fifo", "filo"),
    "inits_productivity": ("low", "medium", "high", "extra"),
    "method_buckets": ("similar-height", "equal-width", "collapsed", "tails", "bellman"),
    "method_pval": ("over", "marg"),
}


@dataclass(frozen=True)
class Constraints:
    """Parameters of a run. Values between 0 and 1 are shares of the rows where `of` is used."""

    min_itm_c: float = 1
    min_itm_in: float = 1
    min_itm_out: float = 0
    min_fin_var: int = 2
    min_fin_in: float = 1
    min_fin_out: float = 0
    min_fin_acc: float = 0.0
    max_fin_pval: float = 1.0
    max_var_s0: int = 3
    max_var_s1: int = 3
    init_minscore: float = 0.0
    max_inits: int = 100
    pair_sel: str = "overall"
    min_impr: float = 0.0
    batch_cap: int = 4
    batch_out: int = 4
    ops_query: tuple[str, ...] = ("and", "or")
    neg_query: bool = True
    single_side_or: bool = False
    parts_type: str = "none"
    method_pval: str = "over"
    mining_algo: str = "greedy"
    method_buckets: str = "similar-height"
    nb_buckets: int = 25
    max_cutpoints: int = 250
    multi_cats: bool = True
    inits_productivity: str = "medium"
    impacc: float = 1.0
    rel_impacc: float = 0.0
    ext_once: bool = False
    lsh_extensions: bool = False
    lsh_filtering: bool = False
    lsh_nb_bands: int = 40
    lsh_nb_rows: int = 0
    lsh_nb_bands_ext: int = 20
    lsh_nb_rows_ext: int = 2
    lsh_min_itm_out: float = 0.0
    nb_ext_buckets: int = 2
    lsh_bucket_mult: int = 5
    lsh_nb_total_exts: int = 10_000
    lsh_random_seed: int = 0
    tree_depth: int = 3
    tree_rounds: int = 6

    def __post_init__(self):
        for name, values in CHOICES.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} = {getattr(self, name)!r} isn't one of {', '.join(values)}")

    def of(self, name: str, rows: int) -> int:
        v = getattr(self, name)
        return round(v * rows) if 0 < v < 1 else int(v)


@dataclass
class Data:
    """Aligned rows with a row number, and the candidate literals or the kinds of the columns of both sides.

    groups: of columns, by name; columns of one group aren't paired or joined. single: both sides are one table.
    """

    rows: DataFrame
    literals: tuple[Sequence[Literal], Sequence[Literal]] = ((), ())
    rid: str = "rid"
    n: int = field(default=0)
    kinds: tuple[dict[str, int], dict[str, int]] | None = None
    groups: dict[str, int] = field(default_factory=dict)
    single: bool = False
    cache: dict = field(default_factory=dict)

    def __post_init__(self):
        self.n = self.n or self.rows.count()

    def supports(self) -> DataFrame:
        """side, lit, rid: the rows of each literal; one scan."""
        marks = [F.when(to_column(x), F.struct(F.lit(s).alias("side"), F.lit(i).alias("lit"))) for s in (0, 1) for i, x in enumerate(self.literals[s])]
        return self.rows.select(self.rid, F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.side", "m.lit", self.rid)

    def hash_range(self) -> int:
        """Row numbers are below it. Hashes must be modulo a prime above them, else several rows share each hash and all minima are small."""
        if "range" not in self.cache:
            top = self.rows.agg(F.max(self.rid)).first()[0] or 0
            self.cache["range"] = max(self.n, int(top) + 1)
        return min(self.cache["range"], WIDE)

    def hashable(self, supports: DataFrame) -> DataFrame:
        """supports with row numbers below the hash range: very large ones, whose products would overflow, are hashed to it."""
        if self.hash_range() < WIDE:
            return supports
        return supports.withColumn(self.rid, F.pmod(F.xxhash64(self.rid), F.lit(WIDE)))

    def coarse(self, c: Constraints) -> tuple[list[list[Q.Atoms]], DataFrame]:
        """The atoms for initial pairs, numbers in buckets, and the rows coded by them."""
        if "coarse" not in self.cache:
            sides = [bucketed(self.rows, kinds, c) for kinds in self.kinds]
            self.cache["coarse"] = (sides, settled(Q.coded(self.rows, sides, self.rid)))
        return self.cache["coarse"]

    def fine(self, c: Constraints) -> tuple[list[list[Q.Atoms]], DataFrame]:
        """The atoms for extensions, numbers in up to max_cutpoints blocks, and the rows coded by them."""
        if "fine" not in self.cache:
            sides = [Q.columns_of(self.rows, kinds, c.max_cutpoints) for kinds in self.kinds]
            self.cache["fine"] = (sides, settled(Q.coded(self.rows, sides, self.rid)))
        return self.cache["fine"]

    def apart(self, a: str, b: str) -> bool:
        """Whether two columns may be in one redescription."""
        x, y = (self.groups.get(v, -1) for v in (a, b))
        return x == -1 or y == -1 or x != y

    def pairable(self, sides: Sequence[Sequence[Q.Atoms]]) -> list[tuple[int, int]]:
        return [(i, j) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[1]) if self.apart(a.var, b.var) and (not self.single or a.var < b.var)]


def bucketed(rows: DataFrame, kinds: dict[str, int], c: Constraints) -> list[Q.Atoms]:
    """Atoms with the numbers in buckets of the method."""
    numbers = [v for v, k in kinds.items() if k == NUMERICAL]
    others = {a.var: a for a in Q.columns_of(rows, {v: k for v, k in kinds.items() if k != NUMERICAL}, c.max_cutpoints)}
    if numbers:
        cells = F.explode(F.array(*(F.struct(F.lit(v).alias("cid"), F.col(f"`{v}`").cast("double").alias("value")) for v in numbers))).alias("e")
        histogram = rows.select(cells).where("e.value IS NOT NULL").groupBy("e.cid", "e.value").agg(F.count("*").alias("n"))
        if histogram.groupBy("cid").count().where(F.col("count") > L.MOST_VALUES).head(1):
            histogram = L.coarse(histogram)
        found: dict[str, list] = {}
        for r in L.bucketize(histogram, c.method_buckets, c.nb_buckets).orderBy("cid", "bucket").collect():
            found.setdefault(r["cid"], []).append((r["low"], r["high"]))
        others |= {v: Q.Atoms(v, NUMERICAL, bounds=tuple(b)) for v, b in found.items() if len(b) > 1}
    return [others[v] for v in kinds if v in others]


def initial_pairs(data: Data, c: Constraints) -> list[dict]:
    """Pairs of literals above the score, in the order of pair_sel, max_inits at most: from all pairs of columns or literals, or with
    lsh_extensions those that agree in a band."""
    if c.lsh_extensions:
        found = lsh_pairs(data, c)
    elif data.kinds:
        sides, rows = data.coarse(c)
        wanted = data.pairable(sides)
        bounds = Q.Bounds(c.of("min_itm_in", data.n), c.of("min_itm_out", data.n))
        found = []
        for k in range(0, len(wanted), 2000):  # so many pairs of columns in one scan
            hits = Q.pairs(rows, sides, wanted[k : k + 2000], c.parts_type, bounds, c.init_minscore, c.inits_productivity, c.multi_cats, c.max_inits)
            for r in hits.collect():  # max_inits for a pair of columns at most
                queries = sides[0][r["left"]].literal(r["taken_l"]), sides[1][r["right"]].literal(r["taken_r"])
                if None not in queries:
                    found.append(from_counts(c, queries, dict(zip(PARTS, r["counts"], strict=True))))
    else:
        found = scored(data, c, [(l, r) for l in data.literals[0] for r in data.literals[1] if data.apart(l.var, r.var) and (not data.single or l.var < r.var)])
    kept = [x for x in found if x["acc"] >= c.init_minscore and enough(data, c, x)]
    if not data.kinds or c.lsh_extensions:
        kept = unlike(kept, c.inits_productivity if data.kinds else "extra")
    return in_order(S.sort(kept, S.BEST_FIRST), c.pair_sel)[: c.max_inits]


def span(x: Literal):
    """What conflicts are told by: an interval, or a set of categories."""
    return set(x.values) if isinstance(x, Cat) else (x.low, x.high) if hasattr(x, "low") else {x.var}


def unlike(items: list[dict], strictness: str) -> list[dict]:
    """Of the pairs on the same two columns those that aren't too alike, the best first."""
    by: dict[tuple, list[dict]] = {}
    for x in items:
        l, r = x["queries"]
        by.setdefault((l.var, r.var), []).append({"left": span(l), "right": span(r), "acc": x["acc"], "item": x})
    return [y["item"] for group in by.values() for y in P.best_pairs(group, strictness)]


def in_order(items: list[dict], how: str) -> list[dict]:
    """overall: the most accurate first; alternate: by accuracy less the worse of the ranks on either column; fifo and filo: as found."""
    if how in ("fifo", "filo"):
        by_text = sorted(items, key=lambda x: (x["left"], x["right"]))
        return by_text if how == "fifo" else by_text[::-1]
    if how == "alternate":
        seen: dict[tuple[int, str], int] = {}
        keyed = []
        for x in items:
            ranks = []
            for s, q in enumerate(x["queries"]):
                key = (s, next(literals(q)).var)
                ranks.append(seen.get(key, 0))
                seen[key] = ranks[-1] + 1
            keyed.append((x["acc"] - max(ranks), x))
        return [x for _, x in sorted(keyed, key=lambda k: -k[0])]
    return items


def lsh_pairs(data: Data, c: Constraints) -> list[dict]:
    """Pairs whose supports agree in a band of MinHash values, scored. With the kinds of columns, numbers take part by all runs of buckets."""
    rows = c.lsh_nb_rows or H.band_rows(c.lsh_nb_bands, c.init_minscore or 0.5)
    p, coeffs = H.next_prime(data.hash_range()), H.coefficients(data.hash_range(), c.lsh_nb_bands, rows, c.lsh_random_seed)
    if not data.kinds:
        tried = H.candidates(H.signatures(data.hashable(data.supports()), coeffs, p, rid=data.rid)).collect()  # pairs of literals, not of rows
        return scored(data, c, [(data.literals[0][i], data.literals[1][j]) for i, j in sorted((r["left"], r["right"]) for r in tried)])
    sides, table = data.coarse(c)
    low, out = c.of("min_itm_in", data.n), c.of("min_itm_out", data.n)
    factor = c.lsh_min_itm_out or (H.out_factor(c.init_minscore, data.n, out) if c.init_minscore else 1.0)
    most = data.n - out * factor
    signed = settled(H.signatures(data.hashable(atom_supports(data, sides, table)), coeffs, p, ("side", "cid", "bucket"), data.rid))
    numeric = [(s, i) for s in (0, 1) for i, a in enumerate(sides[s]) if a.kind == NUMERICAL]
    is_number = F.struct("side", "cid").isin(*(F.struct(F.lit(s), F.lit(i)) for s, i in numeric)) if numeric else F.lit(False)
    single = signed.where(~is_number & (F.col("n") >= max(low, rows)) & (F.col("n") <= most)).select("side", "cid", F.col("bucket").alias("first"), F.col("bucket").alias("last"), "sig")
    runs = H.interval_signatures(signed.where(is_number), c.lsh_nb_bands, rows, low, most)
    banded = H.in_bands(single, "side", "cid", "first", "last").unionByName(H.longest_runs(H.in_bands(runs, "side", "cid", "first", "last")).select("side", "cid", "first", "last", "band", "sig"))
    banded = settled(banded)
    of = lambda s, t: banded.where(F.col("side") == s).select("band", "sig", *(F.col(x).alias(f"{t}_{x}") for x in ("cid", "first", "last")))
    met = of(0, "l").join(of(1, "r"), ["band", "sig"]).select("l_cid", "l_first", "l_last", "r_cid", "r_first", "r_last").distinct()
    met = met.select(F.col("l_cid").alias("left"), "l_first", "l_last", F.col("r_cid").alias("right"), "r_first", "r_last")
    if c.lsh_filtering:
        met = H.without_contained(settled(met))
    allowed = set(data.pairable(sides))
    pairs = []
    for r in met.orderBy("left", "right", "l_first", "l_last", "r_first", "r_last").collect():
        if (r["left"], r["right"]) in allowed:
            queries = tuple(sides[s][r[t]].literal([r[f"{t[0]}_first"], r[f"{t[0]}_last"]] if sides[s][r[t]].kind == NUMERICAL else [r[f"{t[0]}_first"]]) for s, t in ((0, "left"), (1, "right")))
            if None not in queries:
                pairs.append(queries)
    return scored(data, c, list(dict.fromkeys(pairs)))


def atom_supports(data: Data, sides: Sequence[Sequence[Q.Atoms]], table: DataFrame) -> DataFrame:
    """side, cid, bucket, rid: the rows of each atom; of a Boolean those where it is true."""
    marks = [F.when(F.col(f"c{s}_{i}") == 0 if a.kind == BOOLEAN else F.col(f"c{s}_{i}").isNotNull(), F.struct(F.lit(s).alias("side"), F.lit(i).alias("cid"), F.col(f"c{s}_{i}").alias("bucket"))) for s in (0, 1) for i, a in enumerate(sides[s])]
    return table.select(data.rid, F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.side", "m.cid", "m.bucket", data.rid)


def scored(data: Data, c: Constraints, pairs: Sequence[tuple[Node, Node]], chunk: int = 200) -> list[dict]:
    """Items of the pairs, the most accurate first; so many pairs are counted in one scan."""
    out = []
    for k in range(0, len(pairs), chunk):
        part = list(pairs[k : k + chunk])
        for r in evaluate(data.rows, part, c.parts_type).collect():
            stats = {p: r[p] for p in PARTS}
            out.append(item(part[r["pair"]], stats | {"acc": r["acc"]} | measured(stats, c.method_pval, c.parts_type)))
    return S.sort(out, S.BEST_FIRST)


def item(queries: tuple[Node, Node], stats: dict) -> dict:
    a, b = (length(q) for q in queries)
    left, right = X.canonical(queries)
    return stats | {"queries": queries, "left": left, "right": right, "length": a + b, "length_diff": abs(a - b), "support": (stats["n_inter"], stats["Exo"], stats["Eox"])}


def enough(data: Data, c: Constraints, x: dict) -> bool:
    return x["n_inter"] >= c.of("min_itm_in", data.n) and x["n_out"] >= c.of("min_itm_out", data.n)


def from_counts(c: Constraints, queries: tuple[Node, Node], stats: dict[str, int]) -> dict:
    """An item from the counts of its parts."""
    m = measured(stats, c.method_pval, c.parts_type)
    union = sum(stats.values()) - m["n_out"]
    return item(queries, stats | {"acc": m["n_inter"] / union if union else (float("inf") if m["n_inter"] else 0.0)} | m)


def open_sides(c: Constraints, x: dict) -> list[int]:
    """The sides that may still grow."""
    return [s for s, most in ((0, c.max_var_s0), (1, c.max_var_s1)) if length(x["queries"][s]) < most]


def ways(c: Constraints, x: dict, side: int) -> list[tuple[str, bool]]:
    ops = X.allowed_ops(x["queries"][side], x["queries"][1 - side], c.ops_query, c.single_side_or)
    return [(op, neg) for op in ops for neg in ((False, True) if c.neg_query else (False,))]


def free(data: Data, x: dict, var: str) -> bool:
    """Whether a column may join a redescription: it isn't there yet, and none of its group is."""
    used = {y.var for q in x["queries"] for y in literals(q) if hasattr(y, "var")}
    return var not in used and all(data.apart(var, v) for v in used)


def extended(data: Data, c: Constraints, beam: Sequence[dict], seen: X.Seen, suggested: set[tuple[int, int, int]] | None = None) -> list[dict]:
    """All new extensions of the beam that are more accurate, batch_cap for each item and side at most; one job for all.

    suggested: (item, side, column) that are looked at; without, all.
    """
    if data.kinds:
        options = _searched(data, c, beam, suggested)
    else:
        options = _combined(data, c, beam, suggested)
    made: list[dict] = []
    for (i, side), found in sorted(options.items()):
        x = beam[i]
        better = [o for o in found if o[0] > x["acc"] + c.min_impr]
        for _, op, neg, literal, stats in sorted(better, key=lambda o: (-gain(c, o[0], x["acc"]), show(o[3]), o[1], o[2]))[: c.batch_cap]:
            queries = X.apply_extension(x["queries"], side, op, literal, neg)
            if seen.add(queries):
                made.append(from_counts(c, queries, stats))
    return made


def gain(c: Constraints, acc: float, base: float) -> float:
    """The score of an extension: its gain in accuracy, absolute and relative."""
    return c.impacc * (acc - base) + c.rel_impacc * ((acc - base) / base if base else acc)


Options = dict[tuple[int, int], list[tuple[float, str, bool, Literal, dict[str, int]]]]


def _searched(data: Data, c: Constraints, beam: Sequence[dict], suggested: set[tuple[int, int, int]] | None) -> Options:
    sides, rows = data.fine(c)
    wanted, how = [], {}
    for i, x in enumerate(beam):
        for s in open_sides(c, x):
            how[i, s] = ways(c, x, s)
            wanted += [(i, s, k) for k, a in enumerate(sides[s]) if free(data, x, a.var) and (suggested is None or (i, s, k) in suggested)]
    if not wanted:
        return {}
    bounds = Q.Bounds(c.of("min_itm_in", data.n), c.of("min_itm_out", data.n), c.of("min_itm_c", data.n))
    out: Options = {}
    for r in Q.extensions(rows, sides, [x["queries"] for x in beam], how, wanted, c.parts_type, bounds, c.multi_cats).collect():  # one for each way
        if (literal := sides[r["side"]][r["col"]].literal(r["taken"])) is not None:
            out.setdefault((r["item"], r["side"]), []).append((r["acc"], r["op"], r["neg"], literal, dict(zip(PARTS, r["counts"], strict=True))))
    return out


def _combined(data: Data, c: Constraints, beam: Sequence[dict], suggested: set[tuple[int, int, int]] | None) -> Options:
    every = [*data.literals[0], *data.literals[1]]
    first = len(data.literals[0])
    rows = X.literal_parts_of(data.rows, [x["queries"] for x in beam], every).collect() if beam and every else []
    out: Options = {}
    for i, x in enumerate(beam):
        for s in open_sides(c, x):
            at = range(first) if s == 0 else range(first, len(every))
            ok = {k for k in at if free(data, x, every[k].var) and (suggested is None or (i, s, k - (first if s else 0)) in suggested)}
            how = ways(c, x, s)
            scores = X.score_rows(
                [r for r in rows if r["item"] == i and r["lit"] in ok], s, ops=tuple(dict.fromkeys(op for op, _ in how)), negations=tuple(dict.fromkeys(n for _, n in how)),
                kind=c.parts_type, min_in=c.of("min_itm_in", data.n), min_out=c.of("min_itm_out", data.n), min_contribution=c.of("min_itm_c", data.n),
            )
            out[i, s] = [(r["acc"], r["op"], r["neg"], every[r["lit"]], {p: r[p] for p in PARTS}) for r in scores]
    return out


def expand(data: Data, c: Constraints, start: dict | Sequence[dict], seen: X.Seen | None = None) -> list[dict]:
    """Generations of extensions of a pair, each cut to the best; in the end the best of all by the partial selection."""
    seen = seen or X.Seen()
    beam = [start] if isinstance(start, dict) else list(start)
    found = list(beam)
    while beam:
        made = extended(data, c, beam, seen)
        found += made
        beam = [] if c.ext_once else S.cut(S.sort(made, [("acc", True)]), c.batch_cap)
    return partial_of(data, c, found)


def partial_of(data: Data, c: Constraints, found: list[dict]) -> list[dict]:
    return S.partial(c.of("min_itm_out", data.n), c.of("min_itm_in", data.n), c.max_fin_pval, c.batch_out)(found)


def bucket_signatures(data: Data, c: Constraints) -> tuple[DataFrame, list, int]:
    """side, col, band, sig of what a column can add: its truth, its categories, and for numbers buckets of similar height, nb_ext_buckets and
    twice as many in each further round. With their coefficients."""
    if "signed" not in data.cache:
        p, coeffs = H.next_prime(data.hash_range()), H.coefficients(data.hash_range(), c.lsh_nb_bands_ext, c.lsh_nb_rows_ext, c.lsh_random_seed + 1)
        if data.kinds:
            sides, table = data.fine(c)
            supports = atom_supports(data, sides, table).withColumnRenamed("cid", "col")
            sizes = supports.groupBy("side", "col", "bucket").agg(F.count("*").alias("n")).collect()  # the atoms of the columns
            marks: dict[tuple[int, int, int], list[int]] = {}
            for s in (0, 1):
                for k, a in enumerate(sides[s]):
                    of = {r["bucket"]: r["n"] for r in sizes if (r["side"], r["col"]) == (s, k)}
                    upto = np.cumsum([of.get(i, 0) for i in range(len(a))])
                    for i in range(len(a)):
                        if a.kind != NUMERICAL:
                            marks[s, k, i] = [i]
                        else:  # bucket b of round r as one number
                            middle = (upto[i] - of.get(i, 0) / 2) / max(upto[-1], 1)
                            marks[s, k, i] = [r * 1_000_000 + int(middle * c.nb_ext_buckets * 2**r) for r in range(c.lsh_bucket_mult)]
            placed = data.rows.sparkSession.createDataFrame([(*k, v) for k, v in marks.items()], "side int, col int, bucket int, places array<int>")
            keyed = supports.join(F.broadcast(placed), ["side", "col", "bucket"]).select("side", "col", F.explode("places").alias("bucket"), data.rid)  # as many as the atoms
        else:
            keyed = data.supports().select("side", F.col("lit").alias("col"), F.lit(0).alias("bucket"), data.rid)
        signed = H.signatures(data.hashable(keyed), coeffs, p, ("side", "col", "bucket"), data.rid)
        data.cache["signed"] = (settled(H.in_bands(signed, "side", "col").distinct()), coeffs, p)
    return data.cache["signed"]


def suggestions(data: Data, c: Constraints, beam: Sequence[dict], most: int) -> set[tuple[int, int, int]]:
    """The (item, side, column) whose literals agree in a band with where an extension of the item should hold; the ones that agree
    most often, `most` at most."""
    signed, coeffs, p = bucket_signatures(data, c)
    marks = []
    for i, x in enumerate(beam):
        l, r = (to_column(q) for q in x["queries"])
        marks += [F.when(cond, F.struct(F.lit(i).alias("item"), F.lit(op).alias("target"))) for op, cond in (("and", l & r), ("or", l | r)) if op in c.ops_query]
    targets = data.rows.select(data.rid, F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.item", "m.target", data.rid)
    probes = H.in_bands(H.signatures(data.hashable(targets), coeffs, p, ("item", "target"), data.rid), "item")
    met = probes.join(signed, ["band", "sig"]).groupBy("item", "side", "col").agg(F.count("*").alias("n"))
    return {(r["item"], r["side"], r["col"]) for r in met.orderBy(F.desc("n"), "item", "side", "col").limit(most).collect()}


def expand_lsh(data: Data, c: Constraints, starts: Sequence[dict], seen: X.Seen | None = None) -> list[dict]:
    """The most accurate redescriptions first, each extended by the columns that the buckets suggest, until none is left or
    lsh_nb_total_exts columns were tried."""
    seen = seen or X.Seen()
    found, left = list(starts), c.lsh_nb_total_exts
    heap = [(-x["acc"], k, x) for k, x in enumerate(starts)]
    heapq.heapify(heap)
    number = len(heap)
    while heap and left > 0:
        beam = [heapq.heappop(heap)[2] for _ in range(min(max(1, c.batch_cap), len(heap)))]
        tried = suggestions(data, c, beam, left)
        left -= max(1, len(tried))
        made = extended(data, c, beam, seen, tried)
        found += made
        if not c.ext_once:
            for x in S.cut(S.sort(made, [("acc", True)]), c.batch_cap):
                heapq.heappush(heap, (-x["acc"], number, x))
                number += 1
    return found


def mine_itemsets(data: Data, c: Constraints) -> list[dict]:
    """Redescriptions from frequent itemsets over the literals: of the given ones, or single atoms and buckets."""
    lits = data.literals if not data.kinds else tuple([x for a in atoms for i in range(len(a)) if (x := a.literal([i] if a.kind != NUMERICAL else [i, i])) is not None] for atoms in data.coarse(c)[0])
    if not all(lits):
        return []
    least = max(c.of("min_itm_in", data.n), 1) / max(data.n, 1)
    names = [[f"{s}{i}" for i in range(len(lits[k]))] for k, s in enumerate("LR")]
    of: dict[str, set[str]] = {}
    for k in (0, 1):
        for name, x in zip(names[k], lits[k], strict=True):
            of.setdefault(f"{k}{x.var}", set()).add(name)
    excluded = [frozenset(v) for v in of.values() if len(v) > 1]
    rows = I.mine(I.transactions(data.rows, *lits), least, max_length=(c.max_var_s0, c.max_var_s1), min_jaccard=max(c.init_minscore, c.min_fin_acc), excluded=excluded)
    best = rows.orderBy(F.desc("jaccard"), "left", "right").limit(c.max_inits).collect()
    query = lambda k, taken: X.joined([lits[k][int(t[1:])] for t in taken])
    return scored(data, c, [(query(0, r["left"]), query(1, r["right"])) for r in best])


def mine_trees(data: Data, c: Constraints) -> list[dict]:
    """Redescriptions from decision trees, each begun from one literal of an initial pair. Categories take part as 0/1 columns."""
    starts = initial_pairs(data, c)
    if c.mining_algo == "layered" and data.kinds:
        made = [T.layered(data.rows, x["queries"][1 - side], data.kinds, depth=c.tree_depth, min_leaf=max(1, c.of("min_itm_c", data.n)), side=side, cuts=c.max_cutpoints, rid=data.rid) for x in starts for side in (0, 1)]
        best = {steps[T.pick_step([a for _, a in steps])][0]: None for steps in made if steps}
        return [y for y in scored(data, c, list(best)) if enough(data, c, y)]
    kinds = data.kinds or tuple({x.var: {Bool: BOOLEAN, Cat: CATEGORICAL}.get(type(x), NUMERICAL) for x in side} for side in data.literals)
    rows, columns, flags, cats = data.rows, [], set(), {}
    for side in kinds:
        names = [v for v, k in side.items() if k == NUMERICAL]
        for a in Q.columns_of(data.rows, {v: k for v, k in side.items() if k != NUMERICAL}, c.max_cutpoints, 50):
            if a.kind == BOOLEAN:
                names.append(a.var)
                flags.add(a.var)
            for v in a.names:
                name = f"{a.var}__is__{v}"
                rows = rows.withColumn(name, F.col(f"`{a.var}`") == v)
                cats[name] = Cat(a.var, (v,))
                names.append(name)
                flags.add(name)
        columns.append(names)
    rows = settled(rows)
    plain = lambda q: map_literals(q, lambda x: Cat(cats[x.var].var, cats[x.var].values, x.neg) if isinstance(x, Bool) and x.var in cats else x)
    found: dict[tuple[Node, Node], None] = {}
    for x in starts:
        for side in (0, 1):
            start = x["queries"][1 - side]
            for queries, _ in T.alternate(rows, start, tuple(columns), method=c.mining_algo, depth=c.tree_depth, rounds=c.tree_rounds, min_leaf=max(1, c.of("min_itm_c", data.n)), flags=frozenset(flags), side=side)[-1:]:
                found[tuple(map(plain, queries))] = None
    return [y for y in scored(data, c, list(found)) if enough(data, c, y)]


def select_final(data: Data, c: Constraints, items: list[dict]) -> list[dict]:
    return S.final(c.min_fin_var, c.of("min_fin_out", data.n), c.of("min_fin_in", data.n), c.min_fin_acc, c.max_fin_pval)(items)


def mine(data: Data, c: Constraints = Constraints(), only_pairs: bool = False) -> list[dict]:
    """The redescriptions of a run, by its algorithm: greedy, with or without LSH, itemsets or trees; and the final selection."""
    if c.mining_algo == "itemsets":
        return select_final(data, c, mine_itemsets(data, c))
    if c.mining_algo != "greedy":
        return select_final(data, c, mine_trees(data, c))
    pairs = initial_pairs(data, c)
    if only_pairs:
        return select_final(data, c, pairs)
    seen, found = X.Seen(), []
    if c.lsh_extensions:
        return select_final(data, c, expand_lsh(data, c, pairs, seen))
    for x in pairs:
        found += expand(data, c, x, seen)
    return select_final(data, c, found)


def normalized(x: dict) -> dict:
    from ..expressions import normalize

    queries = tuple(normalize(q) for q in x["queries"])
    return x | {"queries": queries, "left": show(queries[0]), "right": show(queries[1]), "length": sum(map(length, queries))}
