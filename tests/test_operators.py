import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolith.expressions import INF, Bool, Cat, Num, parse, show, to_column
from duolith.functions.significance import binomial_tail, exact_overlap, hypergeometric_tail
from duolith.operators import align as A
from duolith.operators import extend as X
from duolith.operators import folds as K
from duolith.operators import graph as G
from duolith.operators import literals as L
from duolith.operators import lsh as H
from duolith.operators import pairs as P
from duolith.operators.support import PARTS, TYPES, evaluate, lengths, measured, negate_parts, part, transition, with_pvalues


@pytest.fixture(scope="module")
def nine(spark):
    """The nine combinations of known and unknown, 1 to 9 times."""
    values = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    rows = [(10 * i + k, *v) for i, v in enumerate(values, 1) for k in range(i)]
    return spark.createDataFrame(rows, "rid long, l boolean, r boolean")


def test_nine_parts_and_accuracies(nine):
    row = evaluate(nine, [(Bool("l"), Bool("r"))]).first()
    counts = {p: row[p] for p in PARTS}
    assert counts == {"Exx": 1, "Exo": 2, "Exm": 3, "Eox": 4, "Eoo": 5, "Eom": 6, "Emx": 7, "Emo": 8, "Emm": 9}
    want = {"rejective": 1 / 7, "optimistic": 20 / 26, "pessimistic": 1 / 40, "positive": 20 / 40, "negative": 1 / 17, "exclu": 6 / 7}
    for kind, acc in want.items():
        assert evaluate(nine, [(Bool("l"), Bool("r"))], kind).first()["acc"] == pytest.approx(acc)
        inter, diff = TYPES[kind]
        n = evaluate(nine, [(Bool("l"), Bool("r"))]).select(*(c.alias(k) for k, c in lengths(kind).items())).first()
        assert n["N"] == 45 and n["I"] + n["D"] == n["U"] == n["N"] - n["O"] and n["A"] <= n["L"]


def test_restricted_and_empty(nine):
    assert evaluate(nine, [(Bool("l"), Bool("r"))], restrict=F.col("r")).first()["Exx"] == 1
    row = evaluate(nine.limit(0), [(Bool("l"), Bool("r"))]).first()
    assert row["acc"] == 0.0 and row["Exx"] == 0


def test_transitions_are_the_logic(nine):
    for op, side in (("and", 0), ("or", 1)):
        for holds in (True, False, None):
            moved = transition(op, side, holds)
            lit = F.lit(holds).cast("boolean")
            l, r = F.col("l"), F.col("r")
            new = (l & lit, r) if side == 0 else (l, r | lit)
            for row in nine.select(part(l, r).alias("a"), part(*new).alias("b")).distinct().collect():
                assert moved[row.a] == row.b
    assert negate_parts(0)["Exo"] == "Eoo" and negate_parts(1)["Emx"] == "Emo"


def test_extension_scores_are_those_of_the_new_queries(spark):
    rng = np.random.default_rng(0)
    pick = lambda: [None if x < 0.1 else bool(x < 0.5) for x in rng.random(300)]
    df = spark.createDataFrame(list(zip(range(300), pick(), pick(), pick())), "rid long, a boolean, b boolean, c boolean")
    for kind in ("rejective", "optimistic", "negative"):
        parts = X.literal_parts(df, Bool("a"), Bool("b"), [Bool("c")])
        rows = X.score_extensions(parts, 1, kind=kind, min_contribution=-1000).collect()
        own = X.score_rows(parts.collect(), 1, kind=kind, min_contribution=-1000)
        key = lambda r: (r["lit"], r["op"], r["neg"], r["contribution"], *(r[p] for p in PARTS))
        assert sorted(map(key, rows)) == sorted(map(key, own))
        for r in rows:
            new = X.apply_extension((Bool("a"), Bool("b")), 1, r["op"], Bool("c"), r["neg"])
            want = evaluate(df, [new], kind).first()
            assert r["acc"] == pytest.approx(want["acc"]) and all(r[p] == want[p] for p in PARTS)


def test_prune_improve_condition_fill(spark):
    rows = [(i, i < 50, i < 50 or i % 7 == 0, i % 2 == 0, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "rid long, a boolean, b boolean, c boolean, n double")
    assert tuple(map(show, X.prune(df, (parse("a & c"), parse("b"))))) == ("a", "b")
    assert tuple(map(show, X.improve(df, (parse("c"), parse("b")), ([Bool("a")], [])))) == ("a", "b")
    cond, acc = X.find_condition(df, (Bool("a"), Bool("b")), [Num("n", -INF, 49.0), Bool("c")])
    assert show(cond) == "[n<49]" and acc == 1.0
    assert tuple(map(show, X.fill_anonymous(df, (parse("?a"), parse("b & ?x")), ([Bool("a"), Bool("a", True)], [])))) == ("a", "b")
    seen = X.Seen()
    assert seen.add((parse("a & b"), parse("c"))) and not seen.add((parse("b & a"), parse("c")))
    assert X.allowed_ops(Bool("a"), parse("a | b"), single_side_or=True) == ("and",)


def test_pvalues(nine):
    assert hypergeometric_tail(3, 20, 7, 8) == pytest.approx(exact_overlap(3, 20, 7, 8))
    assert hypergeometric_tail(0, 20, 7, 8) == 1.0 and hypergeometric_tail(7, 20, 7, 8) == pytest.approx(exact_overlap(7, 20, 7, 8))
    from math import comb

    for k, n, p in ((3, 10, 0.2), (9, 10, 0.9), (1, 5, 0.5), (5, 5, 0.1)):
        assert binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))
    counts = evaluate(nine, [(Bool("l"), Bool("r"))])
    for method in ("over", "marg"):
        for kind in ("none", "optimistic"):
            row = evaluate(nine, [(Bool("l"), Bool("r"))], kind).first()
            mine = measured(row.asDict(), method, kind)
            assert with_pvalues(counts, method, kind).first()["pval"] == pytest.approx(mine["pval"]) and 0 <= mine["pval"] <= 1
    assert 0 <= with_pvalues(counts, "supp", "none", F.lit(0.5), F.lit(0.5)).first()["pval"] <= 1


def test_alignment(spark):
    a = spark.createDataFrame([(3, "x"), (1, "y"), (2, "z"), (9, "w")], "id int, v string")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id int, v double")
    out = A.align(a, b, ["id"], unique=True, check=True)
    assert out.columns == ["id", "v", "v_R"] and {(r.id, r.v, r.v_R) for r in out.collect()} == {(1, "y", 1.0), (2, "z", 2.0), (3, "x", 3.0)}
    with pytest.raises(A.AlignmentError):
        A.align(a.union(a), b, ["id"], unique=True)
    with pytest.raises(A.AlignmentError):
        A.align(a.where("id = 9"), b, ["id"], check=True)
    with pytest.raises(A.AlignmentError):
        A.align_by_position(a, b)
    assert A.align_by_position(a.limit(3).select("v"), b.select(F.col("v").alias("w"))).count() == 3
    n = A.numbered(spark.range(1000).repartition(7), "k", ["id"])
    assert n.where("k <> id").count() == 0 and n.count() == 1000


def test_kinds_and_long_form(spark):
    df = spark.createDataFrame([(1, "true", "1.5", "a", None), (2, "F", "nan", "2", None), (3, "nan", "-2e3", "x", None)], "rid int, b string, n string, c string, e string")
    of = A.kinds(df.drop("rid"), forced={"c": 2})
    assert of == {"b": 1, "n": 3, "c": 2, "e": 1}
    t = A.typed(df, of)
    assert [tuple(r) for r in t.orderBy("rid").select("b", "n", "c").collect()] == [(True, 1.5, "a"), (False, None, "2"), (None, -2000.0, "x")]
    long = A.cells(t, "rid", 0, of)
    assert long.count() == 12
    rows, cols = A.row_and_column_sums(long)
    assert {r.cid: (r.n_true, r.n_numbers) for r in cols.collect()} == {"b": (1, 0), "n": (0, 2), "c": (0, 0), "e": (0, 0)} and rows.count() == 3
    assert A.masked(t, columns="1010", rows="101", rid="rid").columns == ["rid", "b", "c"]
    assert A.weighted(t, F.col("b"), 3, 0).count() == 3


def test_buckets():
    assert L.collapse([1, 2, 3, 4], [3, 3, 1, 1], 4) == [(1, 2, 6), (3, 4, 2)]
    assert L.collapse([1, 2, 3], [1, 9, 1], 4, check_next=True) == [(1, 1, 1), (2, 2, 9), (3, 3, 1)]
    assert L.collapse([1, 2, 3], [1, 1, 1], 10, alone=1) == [(1, 1, 1), (2, 2, 1), (3, 3, 1)]
    assert L.similar_height([0, 1, 2, 3], [50, 5, 5, 5], 65, 3, 50) == [(0, 0, 50), (1, 2, 10), (3, 3, 5)]
    assert L.tails([1, 2, 3, 4, 5, 6], [1] * 6, 2, 1) == [(1, 1, 1), (2, 5, 4), (6, 6, 1)]
    assert L.tails([1, 2], [1, 1], 0, 1) == [(1, 1, 1), (2, 2, 1)]
    assert L.segments([1, 2, 3, 100, 101, 102], [1] * 6, 2) == [(1.0, 3.0, 3), (100.0, 102.0, 3)]
    assert len(L.segments(list(range(20)), [1] * 20, 8, "BIC")) < 8


def test_segments_are_optimal():
    rng = np.random.default_rng(3)
    from itertools import combinations

    v = sorted(set(rng.normal(size=9).round(2).tolist()))
    c = rng.integers(1, 4, len(v)).tolist()
    cost = lambda cuts: sum((np.repeat(v[a:b], c[a:b]) - np.average(v[a:b], weights=c[a:b])) @ (np.repeat(v[a:b], c[a:b]) - np.average(v[a:b], weights=c[a:b])) for a, b in zip((0, *cuts), (*cuts, len(v))))
    got = L.segments(v, c, 3)
    cuts = tuple(v.index(b[0]) for b in got[1:])
    assert cost(cuts) == pytest.approx(min(cost(x) for x in combinations(range(1, len(v)), 2)))


def test_bucketize_and_intervals(spark):
    df = spark.createDataFrame([("x", float(v), 1) for v in range(20)] + [("y", 1.0, 5)], "cid string, value double, n long")
    for method in ("similar-height", "collapsed", "tails", "bellman", "equal-width"):
        rows = L.bucketize(df, method, 4, lower=2, upper=2).collect()
        assert sum(r.n for r in rows if r.cid == "x") == 20 and [r.n for r in rows if r.cid == "y"] == [5]
    assert L.same_rows([1.0, 2.0], 1.2, 1.8) and not L.same_rows([1.0, 2.0], 0.5, 1.5)
    assert L.interval_literal("x", [(0, 1), (2, 3), (4, 5)], 1, 2) == Num("x", 2, INF) and L.interval_literal("x", [(0, 1), (2, 3)], 0, 1) is None
    assert L.category_literal("c", ["a", "b"], ["a", "b", "c"]) == Cat("c", ("c",), True) and L.category_literal("c", [], ["a"]) is None


def test_running_cover_is_the_best_interval():
    rng = np.random.default_rng(2)
    for k in range(200):
        n = int(rng.integers(1, 12))
        num, den = rng.integers(0, 6, (2, n))
        a, b = int(rng.integers(0, 5)), int(rng.integers(5, 9))
        for negative in (False, True):
            sums = lambda i, j: (a + num.sum() - num[i : j + 1].sum(), b + (num + den).sum() - (num + den)[i : j + 1].sum()) if negative else (a + num[i : j + 1].sum(), b + (num + den)[i : j + 1].sum())  # noqa: B023, E731
            want = max(x / y for i in range(n) for j in range(i, n) for x, y in [sums(i, j)])
            assert L.running_cover(num, den, a, b, negative)[2] == pytest.approx(want)


def test_numeric_usability_accepts_either_bound(spark):
    rows = [(0, "n", i, 3, None, None, 0.0 if i < 95 else float(i)) for i in range(100)] + [(0, "b", i, 1, i < 4, None, None) for i in range(100)]
    long = spark.createDataFrame(rows, "side int, cid string, rid int, kind int, b boolean, s string, n double")
    assert {r.cid for r in L.usable(long, 5, 50).collect()} == {"n"}


def test_categories_and_pairs(spark):
    cells = {("a", "x"): 10, ("b", "x"): 8, ("c", "y"): 9, ("a", "y"): 1}
    n_l, n_r = {"a": 11, "b": 8, "c": 9}, {"x": 18, "y": 10}
    greedy = P.combine_categories(cells, n_l, n_r)
    assert greedy[:2] == (("c",), ("y",)) and P.combine_categories(cells, n_l, n_r, exhaustive=2)[2] >= greedy[2]
    a = {"left": {"u"}, "right": (1.0, 3.0), "acc": 0.9}
    b = {"left": {"v"}, "right": (2.0, 4.0), "acc": 0.8}
    assert [len(P.best_pairs([a, b], s)) for s in ("low", "medium", "high", "extra")] == [1, 1, 2, 2]
    df = spark.createDataFrame([("l", "r", False, False, 0.5), ("l", "r", True, True, 0.5), ("l", "q", True, True, 0.5)], "left string, right string, neg_l boolean, neg_r boolean, acc double")
    assert P.without_double_negations(df).count() == 2
    best = P.best_per_key(spark.createDataFrame([("k", 1, 0.2), ("k", 2, 0.7), ("m", 3, 0.1)], "key string, v int, score double"), ["key"], least=0.15)
    assert [tuple(r) for r in best.select("key", "v").collect()] == [("k", 2)]


def test_intervals_over_sparse_grids(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 5, (60, 2)) if (a, b) != (2, 2)]
    df = spark.createDataFrame(rows, "l int, r int")
    got = {(r.l_low, r.l_high, r.r_low, r.r_high): (r.n_inter, r.n_union) for r in P.score_intervals(P.contingency(df, F.col("l"), F.col("r")), min_in=0).collect()}
    for (a, b, c, d), v in got.items():
        i = sum(a <= x <= b and c <= y <= d for x, y in rows)
        u = sum(a <= x <= b or c <= y <= d for x, y in rows)
        assert v == (i, u)
    assert len(got) == 15 * 15


def test_lsh(spark):
    assert H.next_prime(7) == 11 and H.next_prime(0) == 2 and H.band_rows(40, 0.5) == 5
    rng = np.random.default_rng(1)
    n, rows = 400, []
    for i in range(12):
        base = rng.random(n) < rng.uniform(0.1, 0.6)
        other = base ^ (rng.random(n) < 0.04) if i % 2 else rng.random(n) < 0.3
        rows += [(0, i, int(r)) for r in np.flatnonzero(base)] + [(1, i, int(r)) for r in np.flatnonzero(other)]
    s = spark.createDataFrame(rows, "side int, lit int, rid long")
    coeffs, p = H.coefficients(n, 40, 4, seed=3), H.next_prime(n)
    signed = H.signatures(s, coeffs, p)
    r = signed.where("side = 0 AND lit = 1").first()
    mine = [x for k, i, x in rows if (k, i) == (0, 1)]
    assert r.sig[2] == [min((a * x + b) % p for x in mine) for a, b in coeffs[2]] and r.n == len(mine)
    wanted = spark.createDataFrame([(i, i) for i in range(1, 12, 2)], "left int, right int")
    assert H.recall(H.candidates(signed), wanted) >= 0.8
    buckets = spark.createDataFrame([(0, "x", b, 10, [[b + 1, 9 - b]]) for b in range(4)], "side int, cid string, bucket int, n long, sig array<array<long>>")
    runs = {(r["first"], r["last"]): (r.n, r.sig) for r in H.interval_signatures(buckets, 1, 2, 15, 30).collect()}
    assert runs == {(0, 1): (20, [[1, 8]]), (1, 2): (20, [[2, 7]]), (2, 3): (20, [[3, 6]]), (0, 2): (30, [[1, 7]]), (1, 3): (30, [[2, 6]])}
    empty = H.extensions(spark.createDataFrame([(1, False, False)], "rid long, a boolean, b boolean"), Bool("a"), Bool("b"), signed, coeffs, p)
    assert empty.count() == 0
    pairs = spark.createDataFrame([("a", 0, 3, "b", 0, 3), ("a", 1, 2, "b", 0, 3), ("a", 0, 3, "c", 1, 1)], "left string, l_first int, l_last int, right string, r_first int, r_last int")
    assert H.without_contained(pairs).count() == 2


def test_folds_and_randomisation(spark):
    df = spark.range(1000).select(F.col("id").alias("rid"), (F.col("id") % 3 == 0).alias("a"), (F.col("id") % 6 == 0).alias("b"))
    folds = K.equal_folds(df, 7, seed=1)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    assert K.random_folds(df, 4).select("fold").distinct().count() == 4
    assert K.grouped_folds(df, 3, F.floor(F.col("rid") / 10)).groupBy(F.floor(F.col("rid") / 10)).agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert K.column_folds(df.withColumn("f", F.lit("x")), "f").first()["fold"] == "F:x"
    mixed = K.permuted(df, ["b"], seed=2)
    assert mixed.columns == df.columns and mixed.where("b").count() == df.where("b").count() and evaluate(mixed, [(Bool("a"), Bool("b"))]).first()["Exx"] != 167
    table = (np.random.default_rng(0).random((12, 9)) < 0.4).astype(int)
    out = K.swapped(table, 500)
    assert (out.sum(0) == table.sum(0)).all() and (out.sum(1) == table.sum(1)).all() and (out != table).any()
    long = spark.createDataFrame([(k, i, float(i)) for k in "ab" for i in range(9)], "key string, rid int, v double")
    shuffled = K.shuffled_within(long, "key", "v", 4)
    assert sorted(r.v for r in shuffled.where("key = 'a'").collect()) == [float(i) for i in range(9)] and shuffled.where("v <> rid").count() > 0
    found = K.run_folds(df, 3, lambda rows: [(Bool("a"), Bool("b"))])
    assert len(found) == 1 and found[0]["folds"] == [0, 1, 2] and len(found[0]["acc_test"]) == 3
    assert K.selected_rows(df, (Bool("a"), Bool("b"))).count() == 167
    assert K.randomised_pvalue(df, (Bool("a"), Bool("b")), ["b"], 3) == 0.25


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (20, 20)], "a long, b long")
    assert {(r.node, r.component) for r in G.connected_components(edges).collect()} >= {(4, 1), (1, 1), (11, 10)}
    assert {(r.node, r.hops) for r in G.hop_distances(edges, F.col("node") == 1).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    inside = spark.createDataFrame([(1,), (2,), (3,)], "rid long")
    r = G.cohesion(edges, inside).first()
    assert (r.n_inner, r.n_outer) == (2, 1)
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(0).random((60, 2)) * 5)], "rid long, x double, y double")
    near = {(r.a, r.b) for r in G.grid_edges(pts, 0.7).collect()}
    xy = {r.rid: (r.x, r.y) for r in pts.collect()}
    assert near == {(a, b) for a in xy for b in xy if a < b and (xy[a][0] - xy[b][0]) ** 2 + (xy[a][1] - xy[b][1]) ** 2 <= 0.49}


def test_columns_are_plain_spark(nine):
    plan = nine.where(to_column(parse("l & r")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_best_intervals_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        num, den = rng.integers(0, 6, n), rng.integers(0, 6, n)
        a, b, least = int(rng.integers(0, 5)), int(rng.integers(1, 9)), int(rng.integers(0, 8))
        every = [((a + num[i : j + 1].sum()) / (b + (num + den)[i : j + 1].sum()), i - j, -i) for i in range(n) for j in range(i, n) if (num + den)[i : j + 1].sum() >= least]
        got = L.best_run(num, num + den, a, b, least=least, sizes=num + den)
        if not every:
            assert got is None
            continue
        acc, short, first = max((round(x, 12), y, z) for x, y, z in every)
        assert got[2] == pytest.approx(acc) and (got[0] - got[1], -got[0]) == (short, first), (num, den, a, b, least)


def test_p_values_of_a_billion_rows_are_quick():
    began = time.perf_counter()
    assert 0 < hypergeometric_tail(250_050_000, 10**9, 5 * 10**8, 5 * 10**8) < 1e-8
    assert binomial_tail(300_000_000, 10**9, 0.3) == pytest.approx(0.5, abs=1e-4)
    assert time.perf_counter() - began < 0.5
    for k, n, a, b in ((90, 1000, 100, 200), (15, 30, 20, 25), (20, 30, 20, 25), (1, 2, 1, 1), (0, 5, 0, 3)):
        assert hypergeometric_tail(k, n, a, b) == pytest.approx(exact_overlap(k, n, a, b), rel=1e-9)


def test_columns_with_too_many_values_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_VALUES", 50)
    histogram = spark.range(200).select(F.lit("c").alias("cid"), F.col("id").cast("double").alias("value"), F.lit(2).alias("n"))
    with pytest.raises(ValueError, match="coarse"):
        L.bucketize(histogram, "collapsed", 4)
    rows = L.coarse(histogram, 40)
    assert rows.count() == 40 and rows.agg(F.sum("n")).first()[0] == 400
    assert L.bucketize(rows, "collapsed", 4).count() >= 4


def test_hops_and_components_have_no_limit(spark):
    edges = spark.range(130).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert G.connected_components(edges).where("component <> 0").count() == 0
    assert G.hop_distances(edges.where("a < 30"), F.col("node") == 0, 25).agg(F.max("hops")).first()[0] == 25
    assert G.hop_distances(edges.where("a < 30"), F.col("node") == 0).agg(F.max("hops")).first()[0] == 30


def test_swaps_of_a_large_table_are_dealt_to_blocks(spark):
    ones = spark.range(60).select(F.col("id").alias("rid"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("cid")).where((F.col("rid") * 7 + F.col("cid") * 5) % 4 == 0)
    out = K.swapped_blocks(ones, 2, 20, swaps=200).persist()
    for c in ("rid", "cid"):
        assert sorted(map(tuple, out.groupBy(c).count().collect())) == sorted(map(tuple, ones.groupBy(c).count().collect()))
    assert out.distinct().count() == ones.count() and out.exceptAll(ones).count() > 0


def test_fold_columns(spark):
    df = K.equal_folds(spark.range(50).select(F.col("id").alias("rid"), (F.col("id") % 2 == 0).alias("a"), F.lit("x").alias("same")), 5)
    named, of = K.with_fold_column(df)
    assert of == {"folds_split": 2} and K.fold_candidates(named) == ["a", "folds_split"]
    assert sorted(r.fold for r in K.column_folds(named, "folds_split").select("fold").distinct().collect()) == [f"F:F:{i}" for i in range(5)]


def test_extensions_are_registered_by_name(spark):
    from duolith.operators import extensions as E

    pts = spark.createDataFrame([(0, 0.0, 0.0, True), (1, 0.5, 0.0, True), (2, 1.0, 0.0, False), (3, 9.0, 9.0, True), (4, 9.3, 9.0, True), (5, None, 1.0, True)], "rid long, x double, y double, a boolean")
    data = E.Extended(pts).add("geo", reach=0.6)
    r = data.metric("geo", "cohesion", (Bool("a"), Bool("a"))).first()
    assert (r.n_inner, r.n_outer) == (2, 1)
    assert tuple(data.metric("geo", "pieces", (Bool("a"), Bool("a"))).first()) == (2, 2)
    E.register("flat", lambda rows, rid, k: {"t": rows.select(rid)}, size=lambda tables, inside: inside.agg(F.count("*").alias("n")))
    assert E.Extended(pts).add("flat", k=1).metric("flat", "size", (Bool("a"), Bool("a"))).first().n == 5
    with pytest.raises(ValueError):
        E.register("geo", lambda rows: {})
    assert L.rounded(2.3456, [1, 2, 3]) == 2.3 and L.rounded(2.6, [1, 2, 3], upper=True) == 2.6 and L.rounded(2.6, [1, 2, 3]) == 3.0
