import numpy as np
import pytest
from pyspark.sql import functions as F

from duolith.expressions import INF, Bool, Cat, Num, parse, show
from duolith.operators import itemsets as I
from duolith.operators import select as S
from duolith.operators.support import evaluate
from duolith.operators.trees import alternate, fit_tree, pick_step
from duolith.plans import miner as M
from duolith.sources import results as R
from duolith.sources import tables as T
from duolith.streaming.parts import streaming_parts


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random(400) < 0.4, rng.random(400) < 0.5
    n = rng.random(400) * 10
    c = (a & b) ^ (rng.random(400) < 0.03)
    rows = [(i, bool(a[i]), bool(b[i]), float(n[i]), bool(c[i]), "hi" if n[i] > 6 else "lo") for i in range(400)]
    df = spark.createDataFrame(rows, "rid long, a boolean, b boolean, n double, c boolean, d string").cache()
    return M.Data(df, ([Bool("a"), Bool("b"), Num("n", 6.0, INF), Num("n", -INF, 6.0)], [Bool("c"), Cat("d", ("hi",)), Cat("d", ("lo",))]))


def test_beam_finds_the_planted_conjunction(data):
    c = M.Constraints(min_itm_in=0.05, min_itm_out=0.05, max_inits=4, max_var_s0=2, max_var_s1=1, min_fin_var=2, batch_cap=3)
    found = M.mine(data, c)
    sides = {(x["left"], x["right"]) for x in found}
    assert ("a & b", "c") in sides and ("[6<n]", "[d=hi]") in sides
    best = next(x for x in found if x["left"] == "a & b")
    assert best["acc"] == pytest.approx(evaluate(data.rows, [best["queries"]]).first()["acc"]) and best["pval"] < 1e-6
    assert M.mine(data, c, only_pairs=True)[0]["acc"] == pytest.approx(1.0)


def test_lsh_pairs_have_the_best_ones(data):
    found = M.initial_pairs(data, M.Constraints(lsh_extensions=True, lsh_nb_bands=40, lsh_nb_rows=2))
    assert {("[6<n]", "[d=hi]"), ("[n<6]", "[d=lo]")} <= {(x["left"], x["right"]) for x in found}


def test_itemsets(data):
    rows = I.mine(I.transactions(data.rows, data.literals[0], data.literals[1]), 0.05, max_length=(2, 1), min_jaccard=0.7)
    got = {(tuple(r["left"]), tuple(r["right"])): r["jaccard"] for r in rows.collect()}
    assert got[("L0", "L1"), ("R0",)] == pytest.approx(evaluate(data.rows, [(parse("a & b"), parse("c"))]).first()["acc"])
    assert got[("L2",), ("R1",)] == 1.0


def test_trees(data):
    q = fit_tree(data.rows, ["n", "a"], parse("d=hi"), depth=2, flags=frozenset({"a"}))
    assert evaluate(data.rows, [(q, parse("d=hi"))]).first()["acc"] > 0.95
    assert fit_tree(data.rows, ["n"], parse("!!"), depth=2) is None
    planted = evaluate(data.rows, [(parse("a & b"), parse("c"))]).first()["acc"]
    for method in ("cartwheel", "sprit", "split", "layered"):
        steps = alternate(data.rows, parse("c"), (["a", "b"], ["c"]), method=method, depth=2, rounds=6, flags=frozenset("abc"), side=0)
        assert steps and steps[-1][1] >= planted - 0.01, method
    assert pick_step([0.2, 0.895, 0.9]) == 1


def test_selection():
    items = [{"id": i, "acc": a, "length": l, "length_diff": 0, "left": f"l{i % 2}", "right": f"r{i}", "support": i} for i, (a, l) in enumerate([(0.5, 2), (0.9, 3), (0.9, 2), (0.7, 2), (None, 1)])]
    assert [x["id"] for x in S.sort(items, S.BEST_FIRST)] == [2, 1, 3, 0, 4]
    assert [x["id"] for x in S.sort(items, [("acc", False)])] == [4, 0, 3, 1, 2]
    best = S.sort(items, [("acc", True)])
    assert [len(S.cut(best, 1, ["acc"], d)) for d in (1, 0, -1)] == [2, 1, 0] and len(S.cut(best, -2)) == 3
    assert [x["id"] for x in S.filter_single(items, [S.Comparison("acc", ">=", 0.7)])] == [0, 4]
    assert [x["id"] for x in S.filter_single(items, [S.Comparison("acc", ">=", 0.7), S.Comparison("length", "=", 2)], reverse=True)] == [2, 3]
    assert [x["id"] for x in S.filter_pairs(best, S.superceding)] == [1, 2]
    assert [x["id"] for x in S.filter_to_first(best, S.superceding)] == [1, 2, 0, 4]
    c = S.Collection()
    ids = [c.add(x) for x in items]
    c.move(ids[0], "W", "F")
    assert c.complement("W", [1]) == [2, 3, 4] and c.intersection("W", [1, 9]) == [1] and [x["id"] for x in c.of("F")] == [0]
    assert S.redundant("area", 0.3)({"rows": {1, 2}, "cols": {1}}, {"rows": {1, 2, 3}, "cols": {1}}) and len(S.bulk(items[:1], lambda x: x | {"acc": 1.0}, lambda x: 99)) == 2


def test_cut_of_a_frame(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate([0.9, 0.8, 0.8, 0.8, 0.1])], "id int, acc double")
    assert [S.cut_frame(df, 2, [F.desc("acc")], d).count() for d in (1, 0, -1)] == [4, 2, 1]


def test_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text("# note\nid;[2]c;n;n;b\nx;1;2.5;nan;true\ny;2;-1;3;F\n")
    df, forced = T.read_csv(spark, str(tmp_path / "d.csv"))
    assert df.columns == ["id", "c", "n", "n (duplicate#2)", "b"] and forced == {"c": 2}
    (tmp_path / "e.csv").write_text("1,2.0,x\n3,4,y\n")
    df, _ = T.read_csv(spark, str(tmp_path / "e.csv"))
    assert df.columns == ["v0", "v1", "v2"] and df.count() == 2
    (tmp_path / "s.csv").write_text("id,cid,value\nx,p,1\nx,q,2\ny,p,3\n")
    (tmp_path / "p.csv").write_text("id,cid\nx,p\ny,q\n")
    left, right, of_l, of_r = T.import_pair(spark, str(tmp_path / "s.csv"), str(tmp_path / "p.csv"))
    assert {tuple(r) for r in left.collect()} == {("x", 1.0, 2.0), ("y", 3.0, 0.0)} and of_l == {"p": 3, "q": 3}
    assert {tuple(r) for r in right.collect()} == {("x", True, False), ("y", False, True)} and of_r == {"p": 1, "q": 1}
    assert T.write_csv(left, str(tmp_path / "o1"), "id") == "dense" and T.write_csv(right, str(tmp_path / "o2"), "id", density=0.9) == "pairs"
    back, _ = T.read_csv(spark, str(tmp_path / "o2"))
    assert T.from_sparse(back).count() == 2 and T.is_sparse(back)
    with pytest.raises(ValueError):
        (tmp_path / "none.csv").write_text("")
        T.read_csv(spark, str(tmp_path / "none.csv"))


def test_special_columns(spark):
    df = spark.createDataFrame([("enabled_col", "1", "0", None, None), ("groups_col", "2", None, None, None), ("a", "x", "y", "1.5:2", "2020-01-02"), ("b", "z", "w", None, "7")], "id string, u string, v string, lat string, cond_time string")
    rows, enabled, groups = T.take_metadata(df)
    assert rows.count() == 2 and enabled == {"u": True, "v": False} and groups == {"u": "2"}
    placed = T.coordinates(rows.withColumn("long", F.col("lat"))).collect()
    assert [r.lat for r in placed] == [[1.5, 2.0], [T.NO_PLACE]]
    assert [r.cond_time for r in T.condition(rows).collect()] == [1577923200.0, 7.0]


def test_results(spark, data, tmp_path):
    items = M.mine(data, M.Constraints(max_inits=2, max_var_s0=2, max_var_s1=1, batch_cap=1))
    R.save_package(spark, str(tmp_path / "pkg"), data.rows.select("rid", "a", "b", "n"), data.rows.select("rid", "c", "d"), items, M.Constraints())
    left, _, back, manifest = R.load_package(spark, str(tmp_path / "pkg"))
    assert left.count() == 400 and [x["queries"] for x in back] == [x["queries"] for x in items] and manifest["settings"]["max_inits"] == 100
    R.save_pairs(spark, [items[0], items[-1] | {"done": True}], str(tmp_path / "pairs"))
    assert len(R.load_pairs(spark, str(tmp_path / "pairs"))) == 1 and len(R.load_pairs(spark, str(tmp_path / "pairs"), True)) == 2
    R.write_results(spark, data.rows, items[:1], str(tmp_path / "res"), {"n": "weight"})
    assert spark.read.parquet(str(tmp_path / "res/support")).where("part = 'Exx'").count() == items[0]["Exx"]
    assert R.tex_table(items).startswith(r"\begin{tabular}")
    x = items[0] | {"sets": {"test": {"acc": 0.4, "Exx": 1}, "learn": {"acc": 0.8}}}
    assert R.derived(x, "{test:acc:} / {learn:acc:}") == 0.5 and R.derived(x, "{test:acc:} / {cond:acc:}") is None and R.derived(x, "1 / ({:acc:} - {:acc:})") == float("inf")
    assert R.field(x, "BOTH:len:q") == x["length"] and R.field(x, ":len:I") == x["Exx"] and R.field(x, ":perc:N") == 100 and R.shown(0.12345, "acc") == 0.123
    with pytest.raises(ValueError):
        R.derived(x, "__import__('os')")


def test_streaming(spark, data, tmp_path):
    data.rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pairs = [(parse("a"), parse("c")), (parse("b"), parse("c"))]
    q = streaming_parts(stream, pairs).writeStream.outputMode("complete").format("memory").queryName("parts_now").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.pair, r.part): r.n for r in spark.table("parts_now").collect()}
    for r in evaluate(data.rows, pairs).collect():
        assert all(got.get((r.pair, p), 0) == r[p] for p in ("Exx", "Exo", "Eox", "Eoo"))


def test_normalized_items_keep_their_rows(data):
    x = M.normalized({"queries": (parse("(a & b) | (a & !b)"), parse("c"))})
    assert x["left"] == "a" and show(x["queries"][1]) == "c"


def test_settings_that_are_unknown_are_rejected():
    for setting in ({"mining_algo": "magic"}, {"pair_sel": "worst"}, {"inits_productivity": "none"}, {"method_buckets": "round"}):
        with pytest.raises(ValueError, match=next(iter(setting))):
            M.Constraints(**setting)
    assert M.Constraints().mining_algo == "greedy"


@pytest.fixture(scope="module")
def planted(spark):
    """Rows where an odd interval of n and a set of categories go with r, and another interval extends it."""
    rng = np.random.default_rng(12)
    n, m = rng.integers(0, 1000, 1500) / 10, rng.integers(0, 400, 1500) / 4
    cat, b = rng.choice(list("uvwxyz"), 1500), rng.random(1500) < 0.5
    r = (n >= 31.4) & (n <= 57.9) & (m <= 61.25)
    s = np.isin(cat, ["v", "y"])
    rows = [(i, float(n[i]) if i % 50 else None, float(m[i]), str(cat[i]), bool(b[i]), bool(r[i]), "p" if s[i] else ("q" if b[i] else "o")) for i in range(1500)]
    df = spark.createDataFrame(rows, "rid long, n double, m double, cat string, b boolean, r boolean, t string").cache()
    return M.Data(df, kinds=({"n": 3, "m": 3, "cat": 2, "b": 1}, {"r": 1, "t": 2}))


def test_an_interval_that_is_in_no_list_is_found(planted):
    c = M.Constraints(min_itm_in=0.02, min_itm_out=0.1, max_inits=3, max_var_s0=2, max_var_s1=1, batch_cap=2, nb_buckets=8, max_cutpoints=1200, parts_type="rejective")
    found = M.mine(M.Data(planted.rows, kinds=(planted.kinds[0], {"r": 1})), c)
    best = found[0]
    assert best["acc"] > 0.95, best
    # the block edges of 8 buckets are elsewhere; the interval of the extension is cut where the data changes
    bound = best["queries"][0].items[1]
    near = {"n": (31.4, 57.9), "m": (None, 61.25)}[bound.var]
    assert all(v is None or abs(v - x) <= 0.5 for v, x in zip(near, (bound.low, bound.high)))
    exact = evaluate(planted.rows, [best["queries"]], "rejective").first()
    assert best["acc"] == pytest.approx(exact["acc"]) and all(best[p] == exact[p] for p in ("Exx", "Exo", "Eox", "Eoo", "Emx", "Emo"))


def test_categories_are_joined(planted):
    c = M.Constraints(min_itm_in=0.02, min_itm_out=0.1, max_inits=20, max_var_s0=1, max_var_s1=1, nb_buckets=8)
    pairs = M.initial_pairs(planted, c)
    assert any((x["left"], x["right"]) == ("[cat={v,y}]", "[t=p]") and x["acc"] == 1.0 for x in pairs)
    assert all(x["acc"] == pytest.approx(evaluate(planted.rows, [x["queries"]]).first()["acc"]) for x in pairs)
    single = M.initial_pairs(planted, M.Constraints(**(vars(c) | {"multi_cats": False})))
    assert not any("{" in x["left"] for x in single)


def test_pairs_of_columns_against_brute_force(planted):
    from itertools import product

    from duolith.operators import search as Q

    c = M.Constraints(min_itm_in=0.02, min_itm_out=0.1, nb_buckets=5, multi_cats=False, inits_productivity="extra", parts_type="optimistic")
    data = M.Data(planted.rows, kinds=planted.kinds)
    sides, _ = data.coarse(c)
    every = []
    for a, b in product(*sides):
        lits = [[x.literal([i, j] if x.kind == 3 else [i]) for i, j in Q.choices(x.kind, 2 if x.kind == 1 else len(x))] for x in (a, b)]
        every += list(product(*lits))
    want = sorted((round(x["acc"], 9) for x in M.scored(data, c, every) if M.enough(data, c, x)), reverse=True)
    got = [round(x["acc"], 9) for x in M.initial_pairs(data, M.Constraints(**(vars(c) | {"max_inits": 400})))]
    assert got == want[: len(got)] and len(got) == min(400, len(want))


@pytest.mark.parametrize("kind", ["none", "pessimistic", "positive", "negative"])
def test_extensions_against_brute_force(planted, kind):
    from duolith.operators import search as Q

    c = M.Constraints(min_itm_in=0.02, min_itm_out=0.05, min_itm_c=3, max_cutpoints=12, multi_cats=False, parts_type=kind)
    data = M.Data(planted.rows, kinds=planted.kinds)
    start = M.scored(data, c, [(parse("b"), parse("r"))])[0]
    sides, _ = data.fine(c)
    options = M._searched(data, c, [start], None)[0, 0]
    seen = set()
    for acc, op, neg, literal, stats in options:
        queries = M.X.apply_extension(start["queries"], 0, op, literal, neg)
        row = evaluate(data.rows, [queries], kind).first()
        assert acc == pytest.approx(row["acc"]) and all(stats[p] == row[p] for p in stats)
        atoms = next(a for a in sides[0] if a.var == literal.var)
        every = [M.X.apply_extension(start["queries"], 0, op, x, neg) for i, j in Q.choices(atoms.kind, len(atoms)) if (x := atoms.literal([i, j] if atoms.kind == 3 else [i])) is not None]
        best = 0.0
        for x in M.scored(data, c, every):
            old, new = (M.measured({p: y[p] for p in M.PARTS}, "over", kind) for y in (start, x))
            union = lambda m: data.n - m["n_out"]
            change = union(old) - union(new) if op == "and" else new["n_inter"] - old["n_inter"]
            if M.enough(data, c, x) and change >= 3:
                best = max(best, x["acc"])
        assert acc == pytest.approx(best)
        seen.add((literal.var, op, neg))
    assert len({v for v, *_ in seen}) >= 2


def test_lsh_suggests_what_an_exhaustive_search_finds(planted):
    c = M.Constraints(min_itm_in=0.02, min_itm_out=0.1, max_inits=4, max_var_s0=2, max_var_s1=1, batch_cap=2, nb_buckets=8, max_cutpoints=1200, parts_type="rejective", lsh_extensions=True, lsh_nb_rows=2, lsh_nb_bands=30, lsh_nb_bands_ext=40, lsh_nb_rows_ext=1)
    data = M.Data(planted.rows, kinds=(planted.kinds[0], {"r": 1}))
    pairs = M.initial_pairs(data, c)
    assert pairs and all(x["acc"] == pytest.approx(evaluate(data.rows, [x["queries"]], "rejective").first()["acc"]) for x in pairs)
    # the columns that the buckets suggest have the best extension of each pair
    tried = M.suggestions(data, c, pairs, 100)
    every, best = M._searched(data, c, pairs, None), lambda options: max(o[0] for o in options)
    some = M._searched(data, c, pairs, tried)
    assert all(best(some[k]) == best(every[k]) for k in every if best(every[k]) > pairs[k[0]]["acc"])
    found = M.mine(data, c)
    assert max(x["acc"] for x in found) > 0.6
    assert 0 < len(M.suggestions(data, c, pairs[:2], 3)) <= 3
    none = M.mine(data, M.Constraints(**(vars(c) | {"lsh_nb_total_exts": 0})))
    assert [x["queries"] for x in none] == [x["queries"] for x in M.select_final(data, c, pairs)]


def test_orders_and_likeness(planted):
    base = {"min_itm_in": 0.02, "min_itm_out": 0.1, "nb_buckets": 6, "max_inits": 6}
    of = lambda **more: M.initial_pairs(planted_data, M.Constraints(**base, **more))
    planted_data = M.Data(planted.rows, kinds=planted.kinds)
    columns = lambda items: {(x["queries"][0].var, x["queries"][1].var) for x in items}
    low = of(inits_productivity="low", pair_sel="fifo")
    assert len(columns(low)) == len(low)
    assert [x["left"] for x in low] == sorted(x["left"] for x in low)
    assert [x["acc"] for x in of()] == sorted((x["acc"] for x in of()), reverse=True)
    assert len(columns(of(pair_sel="alternate", inits_productivity="extra"))) >= len(columns(of(inits_productivity="extra")))
    grouped = M.Data(planted.rows, kinds=planted.kinds, groups={"cat": 1, "t": 1})
    assert ("cat", "t") not in columns(M.initial_pairs(grouped, M.Constraints(**base)))


@pytest.mark.parametrize("algo", ["itemsets", "cartwheel", "layered"])
def test_other_algorithms_are_reached(planted, algo):
    data = M.Data(planted.rows, kinds=planted.kinds)
    c = M.Constraints(min_itm_in=0.02, min_itm_out=0.1, max_inits=2 if algo != "itemsets" else 40, max_var_s0=2, max_var_s1=1, nb_buckets=6, mining_algo=algo, tree_depth=2, tree_rounds=3, parts_type="rejective", init_minscore=0.1)
    found = M.mine(data, c)
    assert found and all(x["acc"] == pytest.approx(evaluate(data.rows, [x["queries"]], "rejective").first()["acc"]) for x in found)
