import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duolith.expressions import (
    INF, Anon, Bool, Cat, Const, Expr, Group, Num, QueryError, append_group, branches, checked_expression, context, extend, fill, length, minus_anon, minus_one, normalize,
    ordered, parse, parse_many, plain_literals, probability, push_negation, show, sort_key, to_column, truth, truth_table, variables,
)

literal = st.builds(Bool, st.sampled_from("abc"), st.booleans())
query = st.recursive(literal, lambda x: st.builds(Group, st.sampled_from(["and", "or"]), st.lists(x, min_size=1, max_size=3).map(tuple), st.booleans()), max_leaves=6)


@pytest.mark.parametrize("text,node", [
    ("a", Bool("a")),
    ("!a & [b > 2.5]", Group("and", (Bool("a", True), Num("b", 2.5, INF)))),
    ("[-1e3 ≤ some name ≤ 4] ∨ ¬c", Group("or", (Num("some name", -1000, 4), Bool("c", True)))),
    ("4 > b > 1", Num("b", 1, 4)),
    ("c ∉ {x y,z}", Cat("c", ("x y", "z"), True)),
    ("!(a | (b & c))", Group("or", (Bool("a"), Group("and", (Bool("b"), Bool("c")))), True)),
    ("?v3 & !!", Group("and", (Anon("v3"), Const(True)))),
    ("!!!", Const(False)),
    ("[@1970-01-02 < t]", Num("t", 86400.0, INF, time=True)),
    ("", Group("and")),
])
def test_parse(text, node):
    assert parse(text) == node
    assert parse(show(node)) == node


@pytest.mark.parametrize("text", ["a &", "a & b | c", "(a", "[a < ]", "[5 < x < 3]", "a b < c d <"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)
    assert len(parse_many("a\n\nb & c\n")) == 2


@settings(max_examples=150, deadline=None)
@given(query)
def test_transformations_keep_the_meaning(node):
    lits = plain_literals(node)
    for values in product([True, False, None], repeat=len(lits)):
        world = dict(zip(lits, values))
        want = truth(node, world)
        assert truth(push_negation(node), world) == want
        assert truth(ordered(node), world) == want
        if None not in values:
            full = {Bool(v): world.get(Bool(v), False) for v in "abc"}
            assert truth(normalize(node), full) == want
            assert any(all(truth(x, full) for x in b) for b in branches(node)) == want
    assert parse(show(node)) == node or ordered(parse(show(node))) == ordered(node)


def test_tree_operations():
    q = parse("(a & b) | c")
    assert length(q) == 3 and variables(q) == {"a", "b", "c"}
    assert [show(x) for x in minus_one(q)] == ["b | c", "a | c", "a & b"]
    assert show(extend(q, "or", Bool("d"))) == "(a & b) | c | d" and show(extend(q, "and", Bool("d"))) == "((a & b) | c) & d"
    assert show(append_group(Bool("a"), "or", parse("b & c"))) == "a | (b & c)"
    assert context(q, 0) == ("and", [Bool("b")], [Bool("c")])
    assert show(minus_anon(parse("a & ?b"))) == "a" and show(fill(parse("a & ?b"), "b", Num("b", 1, 2))) == "a & [1<b<2]"
    assert show(normalize(parse("(a & b) | (a & !b)"))) == "a" and normalize(parse("a | !a")) == Const(True)
    assert sort_key(Bool("a")) < sort_key(parse("a & b")) < sort_key(parse("a & b & c"))
    assert len(truth_table(q)) == 8
    assert show(parse("[1<b<2]"), "tex") == r"[1 \leq b \leq 2]" and show(parse("!a"), "unicode", {"a": "A"}) == "¬A"


def test_probability():
    q = parse("(a & !b) | c")
    assert probability(q, {Bool("a"): 0.5, Bool("b", True): 0.4, Bool("c"): 0.1}) == pytest.approx(0.2 + 0.1 - 0.02)


def test_columns_follow_kleene(spark):
    rows = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    df = spark.createDataFrame(rows, "a boolean, b boolean")
    for text in ("a & b", "a | b", "!(a & b)", "!a | !b"):
        q = parse(text)
        got = [r.x for r in df.select(to_column(q).alias("x"), "a", "b").collect()]
        assert got == [truth(q, {Bool("a"): a, Bool("b"): b}) for a, b in rows]


def test_column_kinds(spark):
    df = spark.createDataFrame([(1.0, "x", "2020-01-02"), (2.0, "y", "2020-01-03"), (None, None, None)], "n double, c string, t string").withColumn("t", F.to_timestamp("t"))
    count = lambda text: df.where(to_column(parse(text))).count()
    assert [count(t) for t in ("[1<n<2]", "[n<1]", "![n<1]", "c=x", "c!=x", "[@2020-01-02 12:00 < t]", "!!")] == [2, 1, 1, 1, 1, 1, 3]
    assert df.where(to_column(Expr("e", checked_expression("abs(n) + 1 > 2", {"n"})))).count() == 1
    for bad in ("reflect('java.lang.Runtime')", "n; drop", "(select 1)", "java_method(n)"):
        with pytest.raises(QueryError):
            checked_expression(bad, {"n"})
    with pytest.raises(QueryError):
        to_column(parse("?n"))


def test_long_queries_are_simplified_by_absorption():
    from duolith.expressions import normalize, simplified

    names = [f"v{i}" for i in range(14)]
    long = " | ".join(names)
    assert show(normalize(parse(f"({long}) & v0"))) == "v0"
    assert show(normalize(parse(f"({long}) & !v0"))) == show(normalize(parse(f"({' | '.join(names[1:])}) & !v0")))
    rng = random.Random(3)
    for _ in range(300):
        node = parse(" | ".join("(" + " & ".join(rng.choice(["", "!"]) + rng.choice("abcd") for _ in range(rng.randrange(2, 4))) + ")" for _ in range(rng.randrange(2, 5))))
        new = simplified(node)
        for row in product([False, True], repeat=4):
            values = {Bool(n): v for n, v in zip("abcd", row)}
            assert truth(new, values) == truth(node, values)
        assert length(new) <= length(ordered(node))
