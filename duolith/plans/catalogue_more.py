"""Further registered queries: files, the query language, selection, buckets, searches, folds and graphs, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..expressions import INF, Anon, Bool, Cat, Const, Expr, Group, Literal, Node, Num, extend, fill, minus_anon, normalize, parse, plain_literals, probability, push_negation, show, simplified, truth, truth_table
from ..functions.settle import settled, shared_folder
from ..operators import align as A
from ..operators import extend as X
from ..operators import folds as K
from ..operators import graph as G
from ..operators import literals as L
from ..operators import lsh as H
from ..operators import pairs as P
from ..operators import search as Q
from ..operators import select as S
from ..operators.support import PARTS, accuracy, evaluate, lengths, negate_parts, overlaps, part, support, transition, with_pvalues
from ..sources import results as R
from ..sources import tables as T_
from ..streaming.parts import streaming_parts
from . import miner as M
from .catalogue import LEFT, LEFTS, RIGHT, RIGHTS, WIDE, Query, T, all_pairs, counts_sql, named_pairs, pairs_sql, part_sql, ratio_sql, sides, sql_of

Made = tuple[Query, str]


def folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}"


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# Files.
def csv_dense() -> Made:
    """Written with a header and read again, kinds found by the cascade."""

    def run(s: SparkSession, d: str) -> DataFrame:
        df = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") > 0).alias("positive"))
        path = folder(s)
        T_.write_csv(df, path, "id")
        back, forced = T_.read_csv(s, path)
        return A.typed(back, A.kinds(back, forced=forced)).select(F.col("id").cast("long").alias("id"), "balance", "segment", "positive")

    return run, "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, c_acctbal > 0 AS positive FROM customer"


def csv_plain() -> Made:
    """Without a header: the columns are numbered."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        table(s, d, "nation").select("n_nationkey", "n_regionkey", "n_name").write.csv(path, sep=";")
        back, _ = T_.read_csv(s, path)
        typed = A.typed(back, A.kinds(back))
        return typed.select("v0", "v1", "v2")

    return run, "SELECT n_nationkey::DOUBLE AS v0, n_regionkey::DOUBLE AS v1, n_name AS v2 FROM nation"


def csv_forced_kinds() -> Made:
    """Names with a kind in the header, repeated names, and a row of notes."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        lines = table(s, d, "region").select(F.concat_ws(",", "r_regionkey", "r_regionkey", "r_name").alias("value"))
        head = s.createDataFrame([("# regions",), ("[2]key,[3]key,name",)], "value string")
        head.coalesce(1).unionAll(lines.coalesce(1)).coalesce(1).write.text(path)
        back, forced = T_.read_csv(s, path)
        of = A.kinds(back, forced=forced)
        return A.typed(back, of).select("key", F.col("`key (duplicate#2)`").alias("number"), "name", F.lit(of["key"]).alias("kind"))

    return run, "SELECT r_regionkey::VARCHAR AS key, r_regionkey::DOUBLE AS number, r_name AS name, 2 AS kind FROM region"


def sparse_import() -> Made:
    """Triples read into columns; cells without a row are 0."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        counts = table(s, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.concat(F.lit("n_"), F.col("o_orderstatus")).alias("cid")).agg(F.count("*").alias("value"))
        counts.write.csv(path, header=True)
        back, _ = T_.read_csv(s, path)
        wide = T_.from_sparse(back)
        return wide.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("n_F", "n_O", "n_P")))

    cells = ", ".join(f"count(*) FILTER (o_orderstatus = '{x}')::DOUBLE AS \"n_{x}\"" for x in "FOP")
    return run, f"SELECT o_custkey AS id, {cells} FROM orders GROUP BY 1"


def sparse_pairs() -> Made:
    """Pairs of the true cells of Booleans, written and read."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        df = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("debt"), (F.col("c_mktsegment") == "BUILDING").alias("building"))
        T_.to_sparse(df, "id", pairs=True).write.csv(path, header=True)
        back, _ = T_.read_csv(s, path)
        wide = T_.from_sparse(back)
        return wide.select(F.col("id").cast("long").alias("id"), "debt", "building")

    return run, "SELECT c_custkey AS id, c_acctbal < 0 AS debt, c_mktsegment = 'BUILDING' AS building FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'"


def special_columns() -> Made:
    """Coordinates with several points, missing places, and a condition that is a time."""

    def run(s: SparkSession, d: str) -> DataFrame:
        o = table(s, d, "orders")
        place = F.when(F.col("o_orderkey") % 3 > 0, F.concat_ws(":", F.col("o_orderkey") % 7, F.lit("1.5")))
        df = o.select(F.col("o_orderkey").cast("string").alias("id"), place.alias("lat"), place.alias("long"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("cond_time"))
        out = T_.condition(T_.coordinates(df))
        return out.select(F.col("id").cast("long").alias("id"), F.element_at("lat", 1).alias("first_lat"), F.size("long").alias("points"), "cond_time")

    return run, """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 7)::DOUBLE ELSE -361.0::DOUBLE END AS first_lat, CASE WHEN o_orderkey % 3 > 0 THEN 2 ELSE 1 END::INTEGER AS points,
      epoch(o_orderdate::DATE)::DOUBLE AS cond_time FROM orders"""


def coordinates_file() -> Made:
    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array((F.col("c_custkey") % 90).cast("double"), F.lit(2.5)).alias("lat"), F.array(F.col("c_nationkey").cast("double")).alias("long"))
        T_.write_coordinates(c, path)
        back, _ = T_.read_csv(s, path)
        out = T_.coordinates(back)
        return out.select(F.col("id").cast("long").alias("id"), F.element_at("lat", 1).alias("a"), F.element_at("lat", 2).alias("b"), F.element_at("long", 1).alias("c"))

    return run, "SELECT c_custkey AS id, (c_custkey % 90)::DOUBLE AS a, 2.5::DOUBLE AS b, c_nationkey::DOUBLE AS c FROM customer"


def metadata_rows() -> Made:
    """Rows that say which columns are enabled, and their groups, beside rows of data."""

    def run(s: SparkSession, d: str) -> DataFrame:
        n = table(s, d, "nation").select(F.col("n_name").alias("id"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_regionkey").cast("string").alias("region"))
        df = s.createDataFrame([("enabled_col", "1", "0"), ("groups_col", "4", "7")], "id string, key string, region string").unionByName(n)
        rows, enabled, groups = T_.take_metadata(df)
        meta = s.createDataFrame([(c, enabled[c], groups[c]) for c in ("key", "region")], "cid string, enabled boolean, gid string")
        return meta.join(rows.agg(F.count("*").alias("n_rows")))

    return run, "SELECT cid, enabled, gid, (SELECT count(*) FROM nation) AS n_rows FROM (VALUES ('key', true, '4'), ('region', false, '7')) v(cid, enabled, gid)"


def import_both_sides() -> Made:
    """A dense and a sparse file, typed and aligned by their ids."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), "c_mktsegment", "c_acctbal").write.csv(f"{path}/l", header=True)
        table(s, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.col("o_orderpriority").alias("cid")).distinct().write.csv(f"{path}/r", header=True)
        left, right, _, of = T_.import_pair(s, f"{path}/l", f"{path}/r")
        urgent = F.col("`1-URGENT`")
        return A.align(left, right, ["id"]).where(F.lit(of["1-URGENT"]) == 1).select("id", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), urgent.alias("urgent"))

    return run, "SELECT 'c' || c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL"


def transactions_file() -> Made:
    """One side alone, as transactions of items."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        rows = sides(s, d).select(F.col("rid").alias("id"), F.explode(F.array("status", "priority", "flag")).alias("cid")).distinct()
        rows.write.csv(path, header=True)
        side, of = T_.read_transactions(s, path)
        return side.where(F.lit(set(of.values()) == {1})).select(F.col("id").cast("long").alias("id"), F.col("`1-URGENT`").alias("urgent"), F.col("P").alias("pending"))

    return run, T + "SELECT rid AS id, priority = '1-URGENT' AS urgent, status = 'P' AS pending FROM t"


TEXTS = [(LEFT, RIGHT), (WIDE, parse("[qty>100]")), (parse("priority!={1-URGENT,5-LOW}"), parse("!returned & [lines<3]"))]


def _items(s: SparkSession, d: str) -> list[dict]:
    return M.scored(M.Data(sides(s, d)), M.Constraints(), TEXTS)


def _texts_sql(columns: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{show(l)}' AS \"left\", '{show(r)}' AS \"right\", * FROM ({counts_sql(l, r)})" for l, r in TEXTS)
    return T + f", p AS ({rows}) SELECT \"left\", \"right\", {columns} FROM p"


_ACC_SQL = "CASE WHEN Exx + Exo + Eox = 0 THEN 0.0 ELSE Exx::DOUBLE / (Exx + Exo + Eox) END"


def redescription_text() -> Made:
    """Redescriptions written as text and parsed again, with their statistics."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        R.write_redescriptions(s, _items(s, d), path)
        rows = [(show(x["queries"][0]), show(x["queries"][1]), x["acc"], *(x[p] for p in PARTS)) for x in R.read_redescriptions(s, path)]
        return s.createDataFrame(rows, "left string, right string, acc double, " + ", ".join(f"{p} long" for p in PARTS))

    return run, _texts_sql(f"{_ACC_SQL} AS acc, {', '.join(PARTS)}")


def pairs_cache() -> Made:
    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        R.save_pairs(s, [x | {"done": show(x["queries"][1]) == "returned"} for x in _items(s, d)], path)
        return s.createDataFrame([(show(x["queries"][0]), show(x["queries"][1]), x["acc"]) for x in R.load_pairs(s, path)], "left string, right string, acc double")

    return run, _texts_sql(f"{_ACC_SQL} AS acc") + " WHERE \"right\" <> 'returned'"


def package_round_trip() -> Made:
    """Both sides, the redescriptions and the settings in one archive, and out of it again."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        rows = sides(s, d)
        R.save_package(s, path, rows.select("rid", "status", "price"), rows.select("rid", "qty", "returned"), _items(s, d), M.Constraints(max_inits=7))
        left, right, items, manifest = R.load_package(s, path)
        n = left.join(right, "rid").agg(F.count("*").alias("n_rows"), F.count_if("returned").alias("n_returned"))
        return n.withColumn("n_items", F.lit(len(items)).cast("long")).withColumn("max_inits", F.lit(manifest["settings"]["max_inits"]))

    return run, T + f"SELECT count(*) AS n_rows, count(*) FILTER (returned) AS n_returned, {len(TEXTS)}::BIGINT AS n_items, 7 AS max_inits FROM t"


def result_supports() -> Made:
    """The rows of each part of each redescription, as they are written."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        rows = sides(s, d)
        R.write_results(s, rows, [{"queries": q, "acc": 0.0} for q in TEXTS], path)
        return s.read.parquet(f"{path}/support").groupBy("red", "part").agg(F.count("*").alias("n"), F.sum("rid").alias("total"))

    rows = " UNION ALL ".join(f"SELECT 'r{i}' AS red, {part_sql(l, r)} AS part, rid FROM t" for i, (l, r) in enumerate(TEXTS))
    return run, T + f"SELECT red, part, count(*) AS n, sum(rid)::BIGINT AS total FROM ({rows}) WHERE part <> 'Eoo' GROUP BY ALL"


def parameters_file() -> Made:
    """Settings read from an XML file, of which those that are known make the constraints."""

    def run(s: SparkSession, d: str) -> DataFrame:
        from .tasks import constraints, read_settings

        path = folder(s)
        xml = "<preferences><section><parameter><name>min_itm_in</name><value>0.25</value></parameter><parameter><name>max_var_s0</name><value>5</value></parameter><parameter><name>neg_query</name><value>false</value></parameter><parameter><name>ops_query</name><value>and</value></parameter></section></preferences>"
        s.createDataFrame([(xml,)], "value string").coalesce(1).write.text(path)
        c = constraints(read_settings(s, path))
        n = M.Data(sides(s, d)).n
        return s.createDataFrame([(c.of("min_itm_in", n), c.max_var_s0, c.neg_query, ",".join(c.ops_query))], "min_in long, most int, neg boolean, ops string")

    return run, T + "SELECT round(0.25 * count(*))::BIGINT AS min_in, 5 AS most, false AS neg, 'and' AS ops FROM t"


# The query language.
def time_bound() -> Made:
    query = parse("[@1995-03-01 < o_orderdate < @1996-10-15]")
    run = lambda s, d: support(table(s, d, "orders"), query)
    c = "epoch(o_orderdate) BETWEEN epoch(TIMESTAMP '1995-03-01') AND epoch(TIMESTAMP '1996-10-15')"
    return run, f"SELECT count(*) FILTER ({c}) AS n_true, count(*) FILTER (o_orderdate IS NULL) AS n_missing, count(*) FILTER (NOT ({c})) AS n_false FROM orders"


def derived_literals() -> Made:
    """Constants and checked expressions as literals."""
    queries = {"constant": Group("and", (Const(True), LEFT)), "false": Const(False), "expression": Group("or", (Expr("x", "price / lines > 40000"), RIGHT)), "negated": Expr("y", "round(qty) % 2 = 0".replace("%", "-"), True)}
    run_one = lambda rows, name, q: support(rows, q).withColumn("name", F.lit(name))

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d)
        parts = [run_one(rows, n, q) for n, q in queries.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("name", "n_true", "n_missing", "n_false")

    sql = {"constant": "status = 'F'", "false": "false", "expression": "price / lines > 40000 OR returned", "negated": "NOT (round(qty) - 2 = 0)"}
    return run, T + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({c}) AS n_true, count(*) FILTER (({c}) IS NULL) AS n_missing, count(*) FILTER (NOT ({c})) AS n_false FROM t" for n, c in sql.items())


def kleene_truth() -> Made:
    """Queries evaluated row by row on the driver, over all states of two literals."""
    a, b = Bool("a"), Bool("b")
    queries = {"and": Group("and", (a, b)), "or": Group("or", (a, b)), "nand": Group("and", (a, b), True), "mixed": Group("or", (Group("and", (a, Bool("b", True))), b))}

    def run(s: SparkSession, d: str) -> DataFrame:
        states = [True, False, None]
        word = lambda v: "unknown" if v is None else str(v).lower()
        return s.createDataFrame([(n, word(x), word(y), word(truth(q, {a: x, b: y}))) for n, q in queries.items() for x in states for y in states], "name string, a string, b string, holds string")

    sql = {"and": "a AND b", "or": "a OR b", "nand": "NOT (a AND b)", "mixed": "(a AND NOT b) OR b"}
    return run, "WITH s(v) AS (VALUES (true), (false), (NULL)), x AS (SELECT p.v AS a, q.v AS b FROM s p, s q) " + " UNION ALL ".join(f"SELECT '{n}' AS name, coalesce(a::VARCHAR, 'unknown') AS a, coalesce(b::VARCHAR, 'unknown') AS b, coalesce(({c})::VARCHAR, 'unknown') AS holds FROM x" for n, c in sql.items())


def query_probability() -> Made:
    """The chance of a query if its literals were independent, from their shares of the rows."""

    def run(s: SparkSession, d: str) -> DataFrame:
        lits = plain_literals(WIDE)
        rows = sides(s, d)
        n = rows.agg(*(F.avg(X.to_column(x).cast("double")).alias(f"p{i}") for i, x in enumerate(lits))).first()
        return s.createDataFrame([(round(probability(WIDE, {x: n[i] for i, x in enumerate(lits)}), 9),)], "p double")

    return run, T + """, p AS (SELECT avg((status = 'F')::INTEGER) AS a, avg((price <= 200000.5)::INTEGER) AS b, avg((priority = '1-URGENT')::INTEGER) AS c FROM t) SELECT round(a * b + c - a * b * c, 9) AS p FROM p"""


REWRITES: dict[str, tuple[Node, str]] = {
    "normal": (normalize(parse("(status=F & returned) | (status=F & !returned)")), "status = 'F'"),
    "absorbed": (simplified(parse("status=F & (status=F | returned) & (!status=F | [lines>3])")), "status = 'F' AND lines >= 3"),
    "pushed": (push_negation(parse("!(status=F | (returned & [lines<3]))")), "NOT (status = 'F' OR (returned AND lines <= 3))"),
    "extended": (extend(parse("status=F & returned"), "or", Num("lines", 5.0, INF)), "(status = 'F' AND returned) OR lines >= 5"),
    "appended": (extend(parse("status=F"), "and", parse("returned | [lines>5]")), "status = 'F' AND (returned OR lines >= 5)"),
    "filled": (fill(parse("status=F & ?flag"), "flag", Cat("flag", ("R",))), "status = 'F' AND flag = 'R'"),
    "without holes": (minus_anon(Group("and", (LEFT, Anon("flag"), RIGHT))), "status = 'F' AND returned"),
    "reordered": (X.joined([parse(x) for x in ("returned", "[lines>2]", "status=F")]), "returned AND lines >= 2 AND status = 'F'"),
    "from table": (Group("or", tuple(Group("and", tuple(Bool(x.var, not v) for x, v in zip(plain_literals(parse("returned & !open_m")), row))) for row, holds in truth_table(parse("returned & !open_m")) if holds)), "returned AND NOT open_m"),
}


def rewritten_queries() -> Made:
    """Queries after the tree operations, by the rows that they hold for."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d)
        marks = F.array(*(F.struct(F.lit(n).alias("name"), X.to_column(q).alias("holds")) for n, (q, _) in REWRITES.items()))
        return rows.select("rid", F.explode(marks).alias("m")).groupBy("m.name").agg(F.count_if("m.holds").alias("n_true"), F.count_if(F.col("m.holds").isNull()).alias("n_missing"), F.sum(F.when(F.col("m.holds"), F.col("rid"))).alias("total"))

    return run, T + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({c}) AS n_true, count(*) FILTER (({c}) IS NULL) AS n_missing, (sum(rid) FILTER ({c}))::BIGINT AS total FROM t" for n, (_, c) in REWRITES.items())


def shown_queries() -> Made:
    """Queries in each style of text, and their canonical forms."""

    def run(s: SparkSession, d: str) -> DataFrame:
        return s.createDataFrame([(k, show(WIDE, k, {"price": "cost"}, 1), X.canonical((parse("b & a"), parse("c | (a & b)")))[0]) for k in ("text", "unicode", "tex")], "style string, shown string, canonical string")

    rows = [("text", "([status=F] & [cost<200000.5]) | [priority=1-URGENT]"), ("unicode", "([status∈F] ∧ [cost≤200000.5]) ∨ [priority∈1-URGENT]"), ("tex", r"([status \in F] \land [cost \leq 200000.5]) \lor [priority \in 1-URGENT]")]
    return run, "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', 'a & b')" for a, b in rows) + ") v(style, shown, canonical)"


def masks() -> Made:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("rid"), "n_name", F.col("n_regionkey").alias("region"))
        return A.masked(rows, "10", "0110100110010110100101100")

    return run, "SELECT n_nationkey::BIGINT AS rid, n_name FROM nation WHERE substr('0110100110010110100101100', n_nationkey::INTEGER + 1, 1) = '1'"


def category_literals() -> Made:
    """Sets of categories as literals: the complement where that is shorter, none for all or no categories."""
    every = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    chosen = {"one": every[:1], "most": every[1:], "two": every[1:3], "all": every, "none": []}

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d)
        lits = {n: L.category_literal("priority", c, every) for n, c in chosen.items()}
        bounds = [(0.0, 9.0), (10.0, 59.0), (60.0, 400.0)]
        lits |= {"first": L.interval_literal("qty", bounds, 0, 1), "inner": L.interval_literal("qty", bounds, 1, 1), "whole": L.interval_literal("qty", bounds, 0, 2)}
        marks = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(x.neg).alias("neg"), X.to_column(x).alias("holds")) for n, x in lits.items() if x is not None))
        return rows.select(F.explode(marks).alias("m")).groupBy("m.name", "m.neg").agg(F.count_if("m.holds").alias("n"))

    sql = {"one": (False, "priority = '1-URGENT'"), "most": (True, "priority <> '1-URGENT'"), "two": (False, "priority IN ('2-HIGH', '3-MEDIUM')"), "first": (False, "qty <= 59"), "inner": (False, "qty BETWEEN 10 AND 59")}
    return run, T + " UNION ALL ".join(f"SELECT '{n}' AS name, {str(neg).lower()} AS neg, count(*) FILTER ({c}) AS n FROM t" for n, (neg, c) in sql.items())


# Joins and statistics.
def align_by_position() -> Made:
    def run(s: SparkSession, d: str) -> DataFrame:
        left = table(s, d, "nation").select("n_name", "n_nationkey").orderBy("n_name")
        right = table(s, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("k")).orderBy(F.desc("k"))
        return A.align_by_position(left, right).select("rid", "n_name", "k")

    return run, "SELECT a.r - 1 AS rid, n_name, k FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS r FROM nation) a JOIN (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey DESC) AS r FROM nation) b USING (r)"


def numbered_rows() -> Made:
    """One table in the order of a key, numbered without a task that has all rows."""
    run = lambda s, d: A.numbered(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "rid", ["o_totalprice", "o_orderkey"]).select("rid", "o_orderkey")
    return run, "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rid, o_orderkey FROM orders"


def single_table_pairs() -> Made:
    catalog = [(s, c, 2, None) for s in (0, 1) for c in ("a", "b", "c", "d")]
    run = lambda s, d: P.column_pairs(s.createDataFrame(catalog, "side int, cid string, kind int, gid int"), single=True).select("left", "right")
    return run, "WITH c(x) AS (VALUES ('a'), ('b'), ('c'), ('d')) SELECT p.x AS \"left\", q.x AS \"right\" FROM c p JOIN c q ON p.x < q.x"


def unseen_pairs() -> Made:
    """Pairs that weren't explored, in any order of their literals."""
    explored = [(0, 0), (3, 2), (5, 1)]

    def run(s: SparkSession, d: str) -> DataFrame:
        seen = X.Seen()
        for i, j in explored:
            seen.add((LEFTS[i], RIGHTS[j]))
        new = [(i, j) for i, l in enumerate(LEFTS) for j, r in enumerate(RIGHTS) if seen.add((Group("and", (l,)), r))]
        return s.createDataFrame(new, "l int, r int")

    return run, f"SELECT l::INTEGER AS l, r::INTEGER AS r FROM range({len(LEFTS)}) a(l), range({len(RIGHTS)}) b(r) WHERE (l, r) NOT IN ({', '.join(map(str, explored))})"


def pvalue_of_supports() -> Made:
    """The chance of an intersection as large, from the queries' own probabilities."""
    pairs = [(LEFT, RIGHT), (LEFTS[3], RIGHTS[2]), (LEFTS[7], RIGHTS[4])]

    def run(s: SparkSession, d: str) -> DataFrame:
        counts = evaluate(sides(s, d), pairs)
        return with_pvalues(counts, "supp", left_p=F.lit(0.31), right_p=F.lit(0.17) + F.col("pair") * 0.2).select("pair", F.round("pval", 6).alias("pval"))

    rows = " UNION ALL ".join(f"SELECT {i} AS pair, count(*) FILTER (({sql_of(l)}) AND ({sql_of(r)})) AS k, count(*)::DOUBLE AS n, 0.31 * (0.17 + {i} * 0.2) AS p FROM t" for i, (l, r) in enumerate(pairs))
    return run, T + f""", c AS ({rows}), e AS (SELECT pair, n, p::DOUBLE AS p, unnest(range(k, n::BIGINT + 1)) AS i FROM c)
      SELECT pair, round(least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1.0) - (CASE WHEN n - i < 1 THEN 0 ELSE lgamma(n - i + 1) END) + i * ln(p) + (n - i) * ln(1 - p)))), 6) AS pval FROM e GROUP BY pair"""


def overlap_of_areas() -> Made:
    a, b = (WIDE, RIGHT), (parse("status=F & [price>50000]"), parse("returned | [qty>100]"))
    run = lambda s, d: overlaps(sides(s, d), a, b)
    x, y = (f"(({sql_of(p[0])}) AND ({sql_of(p[1])}))" for p in (a, b))
    sql = f""", n AS (SELECT count(*) FILTER ({x} AND {y}) AS i, count(*) FILTER ({x}) AS x, count(*) FILTER ({y}) AS y FROM t),
      r AS (SELECT 'rows' AS what, i, x, y FROM n UNION ALL SELECT 'cols', 3, 4, 4 FROM n UNION ALL SELECT 'area', 3 * i, 4 * x, 4 * y FROM n),
      o AS (SELECT what, i AS n_inter, x + y - i AS n_union, least(x, y) AS n_least FROM r)
      SELECT what, n_inter, n_union, {ratio_sql('n_inter', 'n_union')} AS ratio, {ratio_sql('n_inter', 'n_least')} AS fract_min FROM o"""
    return run, T + sql


def part_moves() -> Made:
    """Where a part goes when a side is joined with a literal, or negated."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = [(op, side, str(holds), p, q) for op in ("and", "or") for side in (0, 1) for holds in (True, False, None) for p, q in transition(op, side, holds).items()]
        rows += [("not", side, "", p, q) for side in (0, 1) for p, q in negate_parts(side).items()]
        return s.createDataFrame(rows, "op string, side int, holds string, part string, new string")

    mark = lambda v: f"CASE WHEN {v} THEN 'x' WHEN NOT {v} THEN 'o' ELSE 'm' END"
    moved = lambda c: f"'E' || {mark(c + '_l')} || {mark(c + '_r')}"
    return run, f"""WITH s(v, w) AS (VALUES (true, 'True'), (false, 'False'), (NULL, 'None')), p AS (SELECT a.v AS p_l, b.v AS p_r FROM s a, s b),
      m AS (SELECT op, side, w AS holds, p_l, p_r, CASE WHEN side = 0 THEN CASE WHEN op = 'and' THEN p_l AND v ELSE p_l OR v END ELSE p_l END AS n_l, CASE WHEN side = 1 THEN CASE WHEN op = 'and' THEN p_r AND v ELSE p_r OR v END ELSE p_r END AS n_r
        FROM p, s, (VALUES ('and'), ('or')) o(op), (VALUES (0), (1)) k(side)
        UNION ALL SELECT 'not', side, '', p_l, p_r, CASE WHEN side = 0 THEN NOT p_l ELSE p_l END, CASE WHEN side = 1 THEN NOT p_r ELSE p_r END FROM p, (VALUES (0), (1)) k(side))
      SELECT op, side, holds, {moved('p')} AS part, {moved('n')} AS new FROM m"""


# Selection.
def _rated(s: SparkSession, d: str) -> list[dict]:
    rows = named_pairs(s, d).orderBy("pid").collect()
    return [r.asDict() | {"id": r["pid"], "tens": r["n_inter"] // 500} for r in rows]


def _numbers(s: SparkSession, items: list[dict]) -> DataFrame:
    return s.createDataFrame([(i, int(x["pid"])) for i, x in enumerate(items)], "place long, pid long")


def sorted_items() -> Made:
    run = lambda s, d: _numbers(s, S.sort(_rated(s, d), [("tens", True), ("acc", False)]))
    return run, T + pairs_sql() + "SELECT row_number() OVER (ORDER BY n_inter // 500 DESC, acc, pid) - 1 AS place, pid FROM p"


def filtered_items() -> Made:
    """Items that meet all tests stay; fields may be None, which comes before all numbers."""

    def run(s: SparkSession, d: str) -> DataFrame:
        items = [x | {"p": None if x["n_inter"] < 900 else x["acc"]} for x in _rated(s, d)]
        return _numbers(s, S.filter_single(items, [S.Comparison("p", ">", 0.15), S.Comparison("tens", "<=", 9)], reverse=True))

    return run, T + pairs_sql() + "SELECT row_number() OVER (ORDER BY pid) - 1 AS place, pid FROM p WHERE n_inter >= 900 AND acc > 0.15 AND n_inter // 500 <= 9"


def first_of_each_left() -> Made:
    """Greedy dedupe: the best of those with the same left side."""
    run = lambda s, d: _numbers(s, S.filter_pairs(S.sort(_rated(s, d), [("acc", True)]), lambda a, b: a["left"] == b["left"]))
    return run, T + pairs_sql() + """SELECT row_number() OVER (ORDER BY acc DESC, pid) - 1 AS place, pid FROM (SELECT *, row_number() OVER (PARTITION BY "left" ORDER BY acc DESC, pid) AS k FROM p) WHERE k = 1"""


def unlike_the_first() -> Made:
    run = lambda s, d: _numbers(s, S.filter_to_first(S.sort(_rated(s, d), [("acc", True)]), lambda a, b: a["right"] == b["right"]))
    return run, T + pairs_sql() + """, f AS (SELECT pid, "right" FROM p ORDER BY acc DESC, pid LIMIT 1) SELECT row_number() OVER (ORDER BY acc DESC, pid) - 1 AS place, pid FROM p WHERE pid = (SELECT pid FROM f) OR "right" <> (SELECT "right" FROM f)"""


def candidate_orders() -> Made:
    def run(s: SparkSession, d: str) -> DataFrame:
        pairs = settled(named_pairs(s, d))
        out = None
        for how in ("overall", "fifo", "filo"):
            one = P.ranked(pairs, how).select(F.lit(how).alias("how"), "pid", "place")
            out = one if out is None else out.unionByName(one)
        return out

    order = {"overall": "acc DESC, pid", "fifo": "pid", "filo": "pid DESC"}
    return run, T + pairs_sql() + " UNION ALL ".join(f"SELECT '{k}' AS how, pid, row_number() OVER (ORDER BY {o})::INTEGER AS place FROM p" for k, o in order.items())


def selection_pipeline() -> Made:
    """The final selection as a pipeline: bounds, order, and no item that another one of the same side supersedes."""

    def run(s: SparkSession, d: str) -> DataFrame:
        items = [x | {"length": 2, "length_diff": 0, "n_out": 10**9, "pval": 0.0, "support": x["n_inter"]} for x in _rated(s, d)]
        c = S.Collection()
        for x in items:
            c.add(x)
        c.select("W", S.final(2, 0, 100, 0.05, 1.0), "F")
        return _numbers(s, c.of("F"))

    sql = """, o AS (SELECT *, row_number() OVER (ORDER BY acc DESC, pid) AS k FROM p WHERE n_inter >= 100 AND acc >= 0.05),
      g AS (SELECT 1 AS pos, [k] AS kept FROM o WHERE k = 1 UNION ALL
        SELECT pos + 1, CASE WHEN EXISTS (SELECT 1 FROM o a, o b WHERE b.k = pos + 1 AND list_contains(kept, a.k) AND ((a."left" = b."left" AND a."right" = b."right") OR ((a."left" = b."left" OR a."right" = b."right") AND a.n_inter <> b.n_inter))) THEN kept ELSE list_append(kept, pos + 1) END
        FROM g WHERE pos < (SELECT count(*) FROM o))
      SELECT row_number() OVER (ORDER BY k) - 1 AS place, pid FROM o WHERE list_contains((SELECT kept FROM g ORDER BY pos DESC LIMIT 1), k)"""
    return run, "WITH RECURSIVE" + T[4:] + pairs_sql() + sql


def weighted_scores() -> Made:
    """The gain in accuracy, absolute and relative, less a penalty for what may be chance."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = named_pairs(s, d).withColumn("pval", F.col("n_inter") / 20000.0)
        return rows.select("pid", F.round(X.weighted_score(F.col("acc"), 0.2, F.col("pval"), impacc=0.8, rel_impacc=0.3, max_pval=0.05, penalty=0.5), 9).alias("score"))

    return run, T + pairs_sql() + "SELECT pid, round(0.8::DOUBLE * (acc - 0.2::DOUBLE) + 0.3::DOUBLE * ((acc - 0.2::DOUBLE) / 0.2::DOUBLE) - CASE WHEN n_inter / 20000.0::DOUBLE > 0.05 THEN 0.5::DOUBLE ELSE 0 END, 9) AS score FROM p"


def best_of_each_column() -> Made:
    def run(s: SparkSession, d: str) -> DataFrame:
        return P.best_per_key(named_pairs(s, d).select("left", "acc", "pid"), ["left"], "acc", 0.1).select("left", "acc")

    return run, T + pairs_sql() + 'SELECT "left", max(acc) AS acc FROM p WHERE acc >= 0.1 GROUP BY "left"'


def double_negations() -> Made:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = named_pairs(s, d).select("left", "right", "acc")
        every = rows.select("left", "right", F.lit(False).alias("neg_l"), F.lit(False).alias("neg_r"), "acc").unionByName(rows.select("left", "right", F.lit(True).alias("neg_l"), F.lit(True).alias("neg_r"), F.when(F.col("acc") > 0.2, F.col("acc")).otherwise(F.col("acc") + 0.5).alias("acc")))
        return P.without_double_negations(every).groupBy("neg_l").agg(F.count("*").alias("n"))

    return run, T + pairs_sql() + "SELECT false AS neg_l, count(*) AS n FROM p UNION ALL SELECT true, count(*) FILTER (acc <= 0.2) FROM p"


def fields_of_items() -> Made:
    """Addresses and arithmetic over the statistics of an item, for rows of learn and test sets."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d)
        stats = {n: evaluate(rows, [(LEFT, RIGHT)], restrict=w).first().asDict() for n, w in (("learn", F.col("rid") % 4 != 0), ("test", F.col("rid") % 4 == 0))}
        x = evaluate(rows, [(LEFT, RIGHT)]).first().asDict() | {"queries": (LEFT, RIGHT), "sets": stats}
        made = [("ratio", R.derived(x, "{test:acc:} / {learn:acc:}")), ("share", R.derived(x, "{:len:I} / {:len:N} * 100 - 1")), ("length", float(R.field(x, "BOTH:len:q"))), ("perc", R.field(x, "learn:perc:U")), ("none", R.derived(x, "1 / ({:len:I} - {:len:I})"))]
        return s.createDataFrame([(n, round(v, 6)) for n, v in made], "name string, v double")

    of = lambda w: f"(SELECT {_ACC_SQL} FROM ({counts_sql(LEFT, RIGHT, w)}))"
    return run, T + f""", a AS (SELECT * FROM ({counts_sql(LEFT, RIGHT)})), l AS (SELECT * FROM ({counts_sql(LEFT, RIGHT, 'rid % 4 <> 0')}))
      SELECT 'ratio' AS name, round({of('rid % 4 = 0')} / {of('rid % 4 <> 0')}, 6) AS v UNION ALL SELECT 'share', round(Exx::DOUBLE / (Exx + Exo + Eox + Eoo) * 100 - 1, 6) FROM a
      UNION ALL SELECT 'length', 2.0 UNION ALL SELECT 'perc', round((Exx + Exo + Eox)::DOUBLE / (Exx + Exo + Eox + Eoo) * 100, 6) FROM l UNION ALL SELECT 'none', 'inf'::DOUBLE"""


# Buckets and intervals.
def _histogram(s: SparkSession, d: str, column: str) -> DataFrame:
    return L.value_counts(sides(s, d), column).withColumn("cid", F.lit(column))


_WALK = """, h AS (SELECT {c} AS value, count(*) AS n, row_number() OVER (ORDER BY {c}) AS k FROM t GROUP BY 1), z AS (SELECT {most} AS most),
  w AS (SELECT k, 0::BIGINT AS bucket, n AS held FROM h WHERE k = 1 UNION ALL
    SELECT h.k, CASE WHEN {close} THEN bucket + 1 ELSE bucket END, CASE WHEN {close} THEN h.n ELSE held + h.n END FROM w JOIN h ON h.k = w.k + 1, z)
  SELECT '{c}' AS cid, bucket::INTEGER AS bucket, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high, sum(n)::BIGINT AS n FROM w JOIN h USING (k) GROUP BY bucket"""


def similar_height() -> Made:
    run = lambda s, d: L.bucketize(_histogram(s, d, "qty"), "similar-height", 20)
    most = "(SELECT CASE WHEN max(n) > sum(n) / 20 THEN (sum(n) - max(n)) / 19 ELSE sum(n) / 20 END FROM h)"
    return run, "WITH RECURSIVE" + T[4:] + _WALK.format(c="qty", most=most, close="held > most OR h.n > most")


def collapsed_buckets() -> Made:
    run = lambda s, d: L.bucketize(_histogram(s, d, "qty"), "collapsed", most=400)
    return run, "WITH RECURSIVE" + T[4:] + _WALK.format(c="qty", most="400", close="held > most")


def tail_buckets() -> Made:
    """Each value of the lowest 5 % and the highest 10 % a bucket, one bucket between them."""
    run = lambda s, d: L.bucketize(_histogram(s, d, "qty"), "tails", lower=0.05, upper=0.1)
    return run, T + """, h AS (SELECT qty AS value, count(*) AS n FROM t GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value) - 1 AS k, sum(n) OVER (ORDER BY value) AS up, sum(n) OVER (ORDER BY value DESC) AS down, sum(n) OVER () AS total FROM h),
      e AS (SELECT count(*) FILTER (up < 0.05 * total) AS a, count(*) - count(*) FILTER (down < 0.1::DOUBLE * total) - 1 AS b FROM r),
      g AS (SELECT r.*, CASE WHEN k < a THEN k WHEN k < b THEN a ELSE k - (b - a) + 1 END AS bucket FROM r, e)
      SELECT 'qty' AS cid, bucket::INTEGER AS bucket, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high, sum(n)::BIGINT AS n FROM g GROUP BY bucket"""


def least_error_segments() -> Made:
    """Three segments of the numbers of lineitems with the least squared error, against all ways to cut."""
    run = lambda s, d: L.bucketize(_histogram(s, d, "lines"), "bellman", 3)
    return run, T + """, h AS (SELECT lines AS v, count(*) AS n FROM t GROUP BY 1), c AS (SELECT a.v AS x, b.v AS y FROM h a JOIN h b ON a.v < b.v),
      g AS (SELECT x, y, v, n, CASE WHEN v < x THEN 0 WHEN v < y THEN 1 ELSE 2 END AS bucket FROM c, h WHERE x > (SELECT min(v) FROM h)),
      e AS (SELECT x, y, bucket, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high, sum(n)::BIGINT AS n, sum(n * v * v) - sum(n * v)::DOUBLE * sum(n * v) / sum(n) AS error FROM g GROUP BY ALL),
      b AS (SELECT x, y FROM e GROUP BY x, y ORDER BY sum(error), x, y LIMIT 1)
      SELECT 'lines' AS cid, bucket::INTEGER AS bucket, low, high, n FROM e JOIN b USING (x, y)"""


def buckets_by_edges() -> Made:
    edges = (0, 20, 45.5, 90, 120, 500)
    run = lambda s, d: sides(s, d).groupBy(L.by_edges(F.col("qty"), edges).alias("bucket")).agg(F.count("*").alias("n"), F.min("qty").alias("low"), F.max("qty").alias("high"))
    return run, T + f"SELECT ({' + '.join(f'(qty >= {e})::INTEGER' for e in edges)} - 1)::INTEGER AS bucket, count(*) AS n, min(qty) AS low, max(qty) AS high FROM t GROUP BY 1"


def best_negative_interval() -> Made:
    """The interval of line counts whose complement is the most accurate extension by or."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d)
        parts = {r["part"]: r["n"] for r in rows.groupBy(part(X.to_column(LEFT), X.to_column(RIGHT)).alias("part")).agg(F.count("*").alias("n")).collect()}
        h = L.part_histogram(rows, "lines", part(X.to_column(LEFT), X.to_column(RIGHT))).groupBy("value").pivot("part", ["Exo", "Eoo"]).sum("n").na.fill(0).orderBy("value").collect()
        a, b = [r["Exo"] for r in h], [r["Eoo"] for r in h]
        i, j, acc = L.best_run(a, b, parts.get("Exx", 0), parts.get("Exx", 0) + parts.get("Exo", 0) + parts.get("Eox", 0), negative=True)
        return s.createDataFrame([(float(h[i]["value"]), float(h[j]["value"]), round(acc, 9))], "low double, high double, acc double")

    return run, T + f""", p AS (SELECT lines AS v, {part_sql(LEFT, RIGHT)} AS part FROM t), h AS (SELECT v, count(*) FILTER (part = 'Exo') AS a, count(*) FILTER (part = 'Eoo') AS b, row_number() OVER (ORDER BY v) AS k FROM p GROUP BY v),
      o AS (SELECT count(*) FILTER (part = 'Exx') AS i, count(*) FILTER (part IN ('Exx', 'Exo', 'Eox')) AS u FROM p),
      c AS (SELECT x.v AS low, y.v AS high, y.k - x.k AS len, x.k, (i + sum(h.a) FILTER (h.v < x.v OR h.v > y.v))::DOUBLE / (u + sum(h.b) FILTER (h.v < x.v OR h.v > y.v)) AS acc FROM h x JOIN h y ON x.v <= y.v, h, o GROUP BY x.v, y.v, x.k, y.k, i, u)
      SELECT low::DOUBLE AS low, high::DOUBLE AS high, round(acc, 9) AS acc FROM c ORDER BY c.acc DESC NULLS LAST, len, k LIMIT 1"""


def same_thresholds() -> Made:
    """Whether two thresholds select the same rows."""
    tries = [(3.0, 3.5), (3.0, 4.0), (7.5, 99.0), (2.5, 2.9), (-5.0, 0.5), (0.5, 1.0)]

    def run(s: SparkSession, d: str) -> DataFrame:
        values = [r["value"] for r in L.value_counts(sides(s, d), "lines").collect()]
        return s.createDataFrame([(a, b, L.same_rows(values, a, b)) for a, b in tries], "a double, b double, same boolean")

    return run, T + f"SELECT a::DOUBLE AS a, b::DOUBLE AS b, count(*) FILTER (lines > a AND lines <= b) = 0 AS same FROM t, (VALUES {', '.join(map(str, tries))}) v(a, b) GROUP BY a, b"


def rounded_thresholds() -> Made:
    """Bounds with as few decimals as keep the rows."""
    bounds = (1.23456, 3.0001, 4.9999, 6.5432)

    def run(s: SparkSession, d: str) -> DataFrame:
        values = [r["value"] for r in L.value_counts(sides(s, d), "lines").collect()]
        return s.createDataFrame([(b, L.rounded(b, values), L.rounded(b, values, upper=True)) for b in bounds], "bound double, low double, high double")

    same = lambda sign: f"(SELECT min_by(round(bound, d::INTEGER), d) FROM (SELECT d, bool_and((lines {sign} bound) = (lines {sign} round(bound, d::INTEGER))) AS ok FROM t, range(12) r(d) GROUP BY d) WHERE ok)"
    return run, T + " UNION ALL ".join(f"SELECT {b}::DOUBLE AS bound, {same('>=').replace('bound', f'{b}::DOUBLE')} AS low, {same('<=').replace('bound', f'{b}::DOUBLE')} AS high" for b in bounds)


# Searches.
def category_sets() -> Made:
    """The two sets of categories, of one or two each, that agree best."""

    def run(s: SparkSession, d: str) -> DataFrame:
        cells = {(r["l"], r["r"]): r["n"] for r in P.contingency(sides(s, d), F.col("status"), F.col("flag")).collect()}
        n_l, n_r = ({k: sum(n for c, n in cells.items() if c[i] == k) for k in {c[i] for c in cells}} for i in (0, 1))
        l, r, acc = P.combine_categories(cells, n_l, n_r, exhaustive=2)
        return s.createDataFrame([(round(acc, 9),)], "acc double")

    sets = lambda c: f"(SELECT DISTINCT [least(a.{c}, b.{c}), greatest(a.{c}, b.{c})] AS s FROM t a, (SELECT DISTINCT {c} FROM t) b WHERE a.rid IN (SELECT min(rid) FROM t GROUP BY {c}))"
    return run, T + f""", l AS {sets('status')}, r AS {sets('flag')}, n AS (SELECT status, flag, count(*) AS n FROM t GROUP BY ALL),
      a AS (SELECT l.s AS x, r.s AS y, sum(n) FILTER (list_contains(l.s, status) AND list_contains(r.s, flag)) AS i, sum(n) FILTER (list_contains(l.s, status) OR list_contains(r.s, flag)) AS u FROM l, r, n GROUP BY ALL)
      SELECT round(max(i::DOUBLE / u), 9) AS acc FROM a"""


_KINDS = ({"status": 2, "lines": 3}, {"flag": 2, "returned": 1})


def searched_pairs() -> Made:
    """The best pair of literals of each pair of columns: an interval or a category with a category or a truth."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d)
        data = M.Data(rows, kinds=({"status": 2, "lines": 3}, {"flag": 2, "returned": 1}))
        found = M.initial_pairs(data, M.Constraints(min_itm_in=10, min_itm_out=10, multi_cats=False, inits_productivity="low", nb_buckets=400))
        return s.createDataFrame([(x["queries"][0].var, x["queries"][1].var, float(x["acc"])) for x in found], "left string, right string, acc double")

    runs = "SELECT 'lines' AS c, a.lines::VARCHAR AS x, b.lines::VARCHAR AS y FROM (SELECT DISTINCT lines FROM t) a JOIN (SELECT DISTINCT lines FROM t) b ON a.lines <= b.lines WHERE NOT (a.lines = (SELECT min(lines) FROM t) AND b.lines = (SELECT max(lines) FROM t))"
    sql = f""", l AS ({runs} UNION ALL SELECT DISTINCT 'status', status, status FROM t), r AS (SELECT DISTINCT 'flag' AS c, flag AS x FROM t UNION ALL SELECT 'returned', 'true'),
      m AS (SELECT l.c AS lc, l.x, l.y, r.c AS rc, r.x AS z, CASE WHEN l.c = 'lines' THEN lines BETWEEN l.x::INTEGER AND l.y::INTEGER ELSE status = l.x END AS a, CASE WHEN r.c = 'flag' THEN flag = r.x ELSE returned END AS b
        FROM (SELECT lines, status, flag, returned FROM t) t, l, r WHERE l.c = 'status' OR l.c = 'lines' AND try_cast(l.x AS INTEGER) IS NOT NULL),
      n AS (SELECT lc, x, y, rc, z, count(*) FILTER (a AND b) AS i, count(*) FILTER (a OR b) AS u, count(*) AS n FROM m GROUP BY ALL)
      SELECT lc AS "left", rc AS "right", max(i::DOUBLE / u) AS acc FROM n WHERE i >= 10 AND n - u >= 10 GROUP BY lc, rc"""
    sql = sql.replace("l.x::INTEGER AND l.y::INTEGER", "try_cast(l.x AS INTEGER) AND try_cast(l.y AS INTEGER)")
    return run, T + sql


def searched_extensions() -> Made:
    """The best interval of line counts, or category, by which a redescription can be extended by and or or."""

    def run(s: SparkSession, d: str) -> DataFrame:
        data = M.Data(sides(s, d), kinds=({"lines": 3, "priority": 2}, {"flag": 2}))
        start = {"queries": (LEFT, RIGHT)}
        c = M.Constraints(min_itm_in=10, min_itm_out=10, multi_cats=False)
        rows = [(lit.var, op, neg, float(acc)) for options in M._searched(data, c, [start], None).values() for acc, op, neg, lit, _ in options]
        return s.createDataFrame([(v, op, max(a for w, o, _, a in rows if (w, o) == (v, op))) for v, op in sorted({(v, op) for v, op, *_ in rows})], "var string, op string, acc double")

    tests = []
    for var, side in (("lines", 0), ("priority", 0), ("flag", 1)):
        span = f"SELECT a.{var} AS x, b.{var} AS y FROM (SELECT DISTINCT {var} FROM t) a JOIN (SELECT DISTINCT {var} FROM t) b ON " + (f"a.{var} <= b.{var} WHERE NOT (a.{var} = (SELECT min({var}) FROM t) AND b.{var} = (SELECT max({var}) FROM t))" if var == "lines" else f"a.{var} = b.{var}")
        for op in ("and", "or"):
            for no in ("", "NOT "):
                lit = f"{no}({var} BETWEEN x AND y)"
                l, r = f"({sql_of(LEFT)})", f"({sql_of(RIGHT)})"
                new = f"({l if side == 0 else r} {op} {lit})"
                a, b = (new, r) if side == 0 else (l, new)
                gain = f"count(*) FILTER ({l} OR {r}) - u" if op == "and" else f"i - count(*) FILTER ({l} AND {r})"
                tests.append(f"SELECT '{var}' AS var, '{op}' AS op, i::DOUBLE / u AS acc FROM (SELECT x, y, count(*) FILTER ({a} AND {b}) AS i, count(*) FILTER ({a} OR {b}) AS u, count(*) AS n, count(*) FILTER ({l} OR {r}) AS u0, count(*) FILTER ({l} AND {r}) AS i0 FROM t, ({span}) GROUP BY x, y) WHERE i >= 10 AND n - u >= 10 AND " + ("u0 - u >= 1" if op == "and" else "i - i0 >= 1"))
                del gain
    return run, T + f"SELECT var, op, max(acc) AS acc FROM ({' UNION ALL '.join(tests)}) GROUP BY var, op"


def one_generation() -> Made:
    """All extensions of a pair by given literals that are more accurate, the best two of a side."""

    def run(s: SparkSession, d: str) -> DataFrame:
        data = M.Data(sides(s, d), (LEFTS, RIGHTS))
        c = M.Constraints(min_itm_in=50, min_itm_out=50, batch_cap=2)
        start = M.scored(data, c, [(LEFT, RIGHT)])[0]
        made = M.extended(data, c, [start], X.Seen())
        return s.createDataFrame([(0 if x["queries"][1] == RIGHT else 1, float(x["acc"]), int(x["Exx"])) for x in made], "side int, acc double, n_inter long")

    tests = []
    l, r = f"({sql_of(LEFT)})", f"({sql_of(RIGHT)})"
    for side, lits, used in ((0, LEFTS, "status"), (1, RIGHTS, "returned")):
        for k, x in enumerate(lits):
            if x.var != used:
                for op in ("and", "or"):
                    for no in ("", "NOT "):
                        new = f"({l if side == 0 else r} {op} {no}({sql_of(x)}))"
                        a, b = (new, r) if side == 0 else (l, new)
                        shown = show(x if not no else type(x)(**(vars(x) | {"neg": True}))).replace("'", "''")
                        tests.append(f"SELECT {side} AS side, '{show(x)}' AS lit, '{op}' AS op, {bool(no)} AS neg, count(*) FILTER ({a} AND {b}) AS i, count(*) FILTER ({a} OR {b}) AS u FROM t")
                        del shown
    return run, T + f""", o AS (SELECT count(*) FILTER ({l} AND {r}) AS i0, count(*) FILTER ({l} OR {r}) AS u0, count(*) AS n FROM t), e AS ({' UNION ALL '.join(tests)}),
      k AS (SELECT side, i::DOUBLE / u AS acc, i, lit, op, neg FROM e, o WHERE i >= 50 AND n - u >= 50 AND i::DOUBLE / u > i0::DOUBLE / u0 AND CASE WHEN op = 'and' THEN u0 - u >= 1 ELSE i - i0 >= 1 END)
      SELECT side, acc, i AS n_inter FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY acc DESC, lit, op, neg) AS place FROM k) WHERE place <= 2"""


def filled_holes() -> Made:
    """The literal of highest accuracy for an anonymous place."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d)
        queries = X.fill_anonymous(rows, (parse("status=F & ?priority"), RIGHT), (LEFTS, RIGHTS))
        return evaluate(rows, [queries]).select("Exx", "Exo", "Eox", "acc")

    rows = " UNION ALL ".join(f"SELECT count(*) FILTER (status = 'F' AND {sql_of(x)} AND returned) AS Exx, count(*) FILTER (status = 'F' AND {sql_of(x)} AND NOT returned) AS Exo, count(*) FILTER (NOT (status = 'F' AND {sql_of(x)}) AND returned) AS Eox FROM t" for x in LEFTS if x.var == "priority")
    return run, T + f"SELECT *, Exx::DOUBLE / (Exx + Exo + Eox) AS acc FROM ({rows}) ORDER BY acc DESC LIMIT 1"


def pruned_and_improved() -> Made:
    """A query with a literal too many, without it, and the best single change of another one."""
    bad = parse("status=F & priority!=1-URGENT")

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d).persist()
        pruned = X.prune(rows, (Group("or", (LEFT, LEFTS[3])), RIGHT))
        better = X.improve(rows, (LEFTS[1], RIGHT), ([x for x in LEFTS if x.var == "status"], [RIGHT]))
        out = evaluate(rows, [pruned, better]).select("pair", "acc")
        out = s.createDataFrame(out.collect(), "pair int, acc double")
        rows.unpersist()
        return out

    del bad
    acc = lambda c: f"(SELECT count(*) FILTER (({c}) AND returned)::DOUBLE / count(*) FILTER (({c}) OR returned) FROM t)"
    both = "status = 'F' OR priority = '1-URGENT'"
    single = ", ".join(acc(f"status = '{x}'") for x in "FOP")
    return run, T + f"""SELECT 0 AS pair, CASE WHEN greatest({acc("status = 'F'")}, {acc("priority = '1-URGENT'")}) > {acc(both)} THEN greatest({acc("status = 'F'")}, {acc("priority = '1-URGENT'")}) ELSE {acc(both)} END AS acc UNION ALL SELECT 1, greatest({single})"""


def found_condition() -> Made:
    """The single literal under which a redescription is the most accurate."""
    conditions: list[Literal] = [Cat("priority", (p,)) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")] + [Num("lines", -INF, 3.0), Num("lines", 5.0, INF)]

    def run(s: SparkSession, d: str) -> DataFrame:
        best = X.conditioned(sides(s, d), (LEFT, RIGHT), conditions).orderBy(F.desc("acc"), "cond").limit(1)
        return best.select("cond", "n_inter", "acc")

    l, r = sql_of(LEFT), sql_of(RIGHT)
    rows = " UNION ALL ".join(f"SELECT {i} AS cond, count(*) FILTER (({l}) AND ({r})) AS n_inter, count(*) FILTER (({l}) OR ({r})) AS u FROM t WHERE {sql_of(c)}" for i, c in enumerate(conditions))
    return run, T + f"SELECT cond, n_inter, n_inter::DOUBLE / u AS acc FROM ({rows}) ORDER BY acc DESC, cond LIMIT 1"


def tree_stump() -> Made:
    """A tree of depth one: the split of the line counts with the least Gini impurity, and what its leaves say."""

    def run(s: SparkSession, d: str) -> DataFrame:
        from ..operators.trees import fit_tree

        rows = settled(sides(s, d))
        query = fit_tree(rows, ["lines"], parse("[qty>100]"), depth=1)
        return evaluate(rows, [(query, parse("[qty>100]"))]).select("Exx", "Exo", "Eox", "Eoo")

    return run, T + """, h AS (SELECT lines AS v, count(*) AS n, count(*) FILTER (qty >= 100) AS p FROM t GROUP BY 1),
      c AS (SELECT x.v AS cut, sum(h.n) FILTER (h.v <= x.v) AS n1, sum(h.p) FILTER (h.v <= x.v) AS p1, sum(h.n) FILTER (h.v > x.v) AS n2, sum(h.p) FILTER (h.v > x.v) AS p2 FROM h x, h GROUP BY x.v),
      g AS (SELECT cut, n1, p1, n2, p2, 2 * p1::DOUBLE * (n1 - p1) / n1 + 2 * p2::DOUBLE * (n2 - p2) / n2 AS impurity FROM c WHERE n2 > 0),
      b AS (SELECT cut, p1 > n1 - p1 AS low, p2 > n2 - p2 AS high FROM g ORDER BY impurity LIMIT 1), q AS (SELECT CASE WHEN lines <= cut THEN low ELSE high END AS l, qty >= 100 AS r FROM t, b)
      SELECT count(*) FILTER (l AND r) AS Exx, count(*) FILTER (l AND NOT r) AS Exo, count(*) FILTER (NOT l AND r) AS Eox, count(*) FILTER (NOT l AND NOT r) AS Eoo FROM q"""


def first_layer() -> Made:
    """The first layer of a tree over numbers and categories: the split with the least Gini impurity among all columns."""
    target = parse("[qty>100]")

    def run(s: SparkSession, d: str) -> DataFrame:
        from ..operators.trees import Leaf, next_layer, query_of

        rows = sides(s, d)
        atoms = [Q.columns_of(rows, {"lines": 3, "priority": 2}, 50), []]
        leaves = next_layer(settled(Q.coded(rows, atoms, "rid")), atoms[0], [Leaf()], target, 0, min_leaf=20)
        return evaluate(rows, [(query_of(leaves), target)]).select("Exx", "Exo", "Eox", "Eoo")

    return run, T + """, h AS (SELECT lines AS v, count(*) AS n, count(*) FILTER (qty >= 100) AS p FROM t GROUP BY 1),
      c AS (SELECT x.v AS cut, sum(h.n) FILTER (h.v <= x.v) AS n1, sum(h.p) FILTER (h.v <= x.v) AS p1, sum(h.n) FILTER (h.v > x.v) AS n2, sum(h.p) FILTER (h.v > x.v) AS p2 FROM h x, h GROUP BY x.v),
      s AS (SELECT 'n' AS kind, cut::VARCHAR AS cut, n1, p1, n2, p2 FROM c WHERE n1 >= 20 AND n2 >= 20 UNION ALL
        SELECT 'c', priority, count(*), count(*) FILTER (qty >= 100), (SELECT count(*) FROM t) - count(*), (SELECT count(*) FILTER (qty >= 100) FROM t) - count(*) FILTER (qty >= 100) FROM t GROUP BY priority),
      b AS (SELECT kind, cut, p1 * 2 > n1 AS low, p2 * 2 > n2 AS high FROM s ORDER BY 2 * p1::DOUBLE * (n1 - p1) / n1 + 2 * p2::DOUBLE * (n2 - p2) / n2 LIMIT 1),
      q AS (SELECT CASE WHEN CASE WHEN kind = 'n' THEN lines <= try_cast(cut AS INTEGER) ELSE priority = cut END THEN low ELSE high END AS l, qty >= 100 AS r FROM t, b)
      SELECT count(*) FILTER (l AND r) AS Exx, count(*) FILTER (l AND NOT r) AS Exo, count(*) FILTER (NOT l AND r) AS Eox, count(*) FILTER (NOT l AND NOT r) AS Eoo FROM q"""


def run_signatures() -> Made:
    """MinHash values of runs of buckets, from those of the buckets."""
    coeffs, prime = [[(7, 11), (101, 5)], [(20, 40), (118, 36)]], 1_000_003

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d).select(F.lit(1).alias("side"), F.lit("qty").alias("cid"), F.floor(F.col("qty") / 60).cast("int").alias("bucket"), "rid")
        signed = H.signatures(rows, coeffs, prime, ("side", "cid", "bucket"))
        out = H.interval_signatures(signed, 2, 2, 100, 12_000)
        return out.select("first", "last", "n", F.concat_ws(",", F.transform(F.flatten("sig"), lambda x: x.cast("string"))).alias("sig"))

    mins = ", ".join(f"min(({a} * rid + {b}) % {prime})" for band in coeffs for a, b in band)
    return run, T + f""", x AS (SELECT floor(qty / 60)::INTEGER AS k, rid FROM t), b AS (SELECT DISTINCT k FROM x)
      SELECT p.k AS first, q.k AS last, count(*) AS n, array_to_string([{mins}], ',') AS sig FROM b p JOIN b q ON p.k <= q.k JOIN x ON x.k BETWEEN p.k AND q.k GROUP BY ALL HAVING count(*) BETWEEN 100 AND 12000"""


def literal_rows() -> Made:
    """Rows by literals in long form: what the itemsets are counted on."""
    run = lambda s, d: M.Data(sides(s, d), (LEFTS, RIGHTS), n=1).supports().groupBy("rid").agg(F.count("*").alias("n_items"), F.sum(F.col("side") * 100 + F.col("lit")).alias("total"))
    rows = " UNION ALL ".join(f"SELECT rid, {100 * k + i} AS item FROM t WHERE {sql_of(x)}" for k, lits in enumerate((LEFTS, RIGHTS)) for i, x in enumerate(lits))
    return run, T + f"SELECT rid, count(*) AS n_items, sum(item)::BIGINT AS total FROM ({rows}) GROUP BY rid"


def derived_columns() -> Made:
    """Columns that are computed from others again after these changed."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d).select("rid", "price", "lines").withColumn("price", F.round(F.col("price") * 2, 2))
        return A.recomputed(rows, {"per_line": "round(price / lines, 6)", "dear": "price > 300000"}).select("rid", "per_line", "dear")

    return run, T + "SELECT rid, round(round(price * 2, 2) / lines, 6) AS per_line, round(price * 2, 2) > 300000 AS dear FROM t"


def possible_columns() -> Made:
    """Numerical columns that some extension within the bounds can be made of, before any search."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d)
        p = part(X.to_column(LEFT), X.to_column(RIGHT))
        out = None
        for c in ("lines", "qty", "price"):
            one = L.feasible(L.part_histogram(rows, c, p), 1, 60, 60).select(F.lit(c).alias("cid"), "op", "possible")
            out = one if out is None else out.unionByName(one)
        return out

    rows = " UNION ALL ".join(f"SELECT '{c}' AS cid, {part_sql(LEFT, RIGHT)} AS part FROM t WHERE {c} IS NOT NULL" for c in ("lines", "qty", "price"))
    return run, T + f""", n AS (SELECT cid, count(*) FILTER (part = 'Exx') AS xx, count(*) FILTER (part = 'Exo') AS xo, count(*) FILTER (part = 'Eox') AS ox, count(*) FILTER (part = 'Eoo') AS oo FROM ({rows}) GROUP BY cid)
      SELECT cid, 'and' AS op, xx >= 60 AND oo + ox >= 60 AS possible FROM n UNION ALL SELECT cid, 'or', xx + xo >= 60 AND oo >= 60 FROM n"""


# Folds, randomisation, graphs, streams.
_DRAWN = "('0x' || substr(md5(concat_ws(':', {})), 1, 12))::BIGINT"


def random_folds() -> Made:
    run = lambda s, d: K.random_folds(sides(s, d), 5, 7).groupBy("fold").agg(F.count("*").alias("n"), F.sum("rid").alias("total"))
    return run, T + f"SELECT ({_DRAWN.format('7, rid')} % 5)::INTEGER AS fold, count(*) AS n, sum(rid)::BIGINT AS total FROM t GROUP BY 1"


def equal_folds() -> Made:
    run = lambda s, d: K.equal_folds(sides(s, d), 4, 3).groupBy("fold").agg(F.count("*").alias("n"), F.sum("rid").alias("total"))
    return run, T + f"SELECT (k % 4)::INTEGER AS fold, count(*) AS n, sum(rid)::BIGINT AS total FROM (SELECT rid, row_number() OVER (ORDER BY {_DRAWN.format('3, rid')}, rid) - 1 AS k FROM t) GROUP BY 1"


def grouped_folds() -> Made:
    run = lambda s, d: K.grouped_folds(sides(s, d), 3, F.floor(F.col("price") * 0.001), 5).groupBy("fold").agg(F.count("*").alias("n"), F.sum("rid").alias("total"))
    return run, T + f"SELECT ({_DRAWN.format('5, floor(price * 0.001::DOUBLE)::BIGINT')} % 3)::INTEGER AS fold, count(*) AS n, sum(rid)::BIGINT AS total FROM t GROUP BY 1"


def folds_of_a_column() -> Made:
    """Folds written as a column, found among the columns, and read from it."""

    def run(s: SparkSession, d: str) -> DataFrame:
        named, _ = K.with_fold_column(K.equal_folds(sides(s, d).select("rid", "status", "returned"), 4, 3))
        column = next(c for c in K.fold_candidates(named) if c.startswith("folds"))
        return K.column_folds(named, column).groupBy("fold").agg(F.count("*").alias("n"))

    return run, T + "SELECT 'F:F:' || (k % 4) AS fold, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY rid) - 1 AS k FROM t) GROUP BY 1"


def folded_run(names: tuple[Node, Node] = (LEFT, RIGHT)) -> Made:
    """A redescription that each fold's run finds: its accuracies on the folds' learn and test sets."""

    def run(s: SparkSession, d: str) -> DataFrame:
        found = K.run_folds(sides(s, d), 3, lambda rows: [names], 1)
        return s.createDataFrame([(f, a, b) for x in found for f, a, b in zip(x["folds"], x["acc_learn"], x["acc_test"])], "fold int, acc_learn double, acc_test double")

    l, r = (f"({sql_of(q)})" for q in names)
    return run, T + f""", f AS (SELECT ({_DRAWN.format('1, rid')} % 3)::INTEGER AS fold, count(*) FILTER ({l} AND {r}) AS i, count(*) FILTER ({l} OR {r}) AS u FROM t GROUP BY 1)
      SELECT fold, (sum(i) OVER () - i)::DOUBLE / (sum(u) OVER () - u) AS acc_learn, i::DOUBLE / u AS acc_test FROM f"""


def permuted_side() -> Made:
    run = lambda s, d: K.permuted(sides(s, d).select("rid", "status", "qty"), ["qty"], 11).select("rid", "status", "qty")
    return run, T + f", a AS (SELECT rid, status, row_number() OVER (ORDER BY rid) AS k FROM t), b AS (SELECT qty, row_number() OVER (ORDER BY {_DRAWN.format('11, rid')}, rid) AS k FROM t) SELECT rid, status, qty FROM a JOIN b USING (k)"


def shuffled_traits() -> Made:
    """The values of each trait in another order, each on its own."""

    def run(s: SparkSession, d: str) -> DataFrame:
        long = table(s, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("rid"), F.col("c_acctbal").alias("value"))
        return K.shuffled_within(long, "key", "value", 4).select("key", "rid", "value")

    return run, f"""WITH a AS (SELECT c_mktsegment AS key, c_custkey AS rid, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer),
      b AS (SELECT c_mktsegment AS key, c_acctbal AS value, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_DRAWN.format('4, c_mktsegment, c_custkey')}, c_custkey) AS k FROM customer) SELECT key, rid, value FROM a JOIN b USING (key, k)"""


def swapped_sums() -> Made:
    """Row and column sums after checkerboard swaps: they stay."""

    def run(s: SparkSession, d: str) -> DataFrame:
        ones = table(s, d, "orders").select((F.col("o_custkey") % 300).alias("rid"), F.concat("o_orderpriority", "o_orderstatus").alias("cid")).distinct()
        out = settled(K.swapped_blocks(ones, 2, 100, swaps=2000))
        sums = lambda c: out.groupBy(F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n"))
        return sums("rid").unionByName(sums("cid"))

    return run, "WITH x AS (SELECT DISTINCT o_custkey % 300 AS rid, o_orderpriority || o_orderstatus AS cid FROM orders) SELECT rid::VARCHAR AS name, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT cid, count(*) FROM x GROUP BY 1"


def rows_of_a_redescription() -> Made:
    run = lambda s, d: K.selected_rows(sides(s, d), (LEFT, RIGHT), "union").select("rid", "status", "returned")
    return run, T + "SELECT rid, status, returned FROM t WHERE status = 'F' OR returned"


def hops() -> Made:
    """The shortest ways from the first customer of each chain of neighbours."""

    def run(s: SparkSession, d: str) -> DataFrame:
        c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
        a, b = c.select(F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("m")), c.select(F.col("c_custkey").alias("b"), (F.col("c_custkey") - 1).alias("a"), F.col("c_mktsegment").alias("m"))
        return G.hop_distances(a.join(b, ["a", "m"]).select("a", "b"), F.col("node") % 50 == 0)

    return run, """WITH RECURSIVE e AS (SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 AND x.c_mktsegment = y.c_mktsegment), z AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      w AS (SELECT DISTINCT a AS node, 0 AS hops FROM z WHERE a % 50 = 0 UNION SELECT b, hops + 1 FROM w JOIN z ON node = a WHERE hops < 60) SELECT node, min(hops) AS hops FROM w GROUP BY node"""


def near_places() -> Made:
    """Places no further apart than a reach, by cells of a grid."""

    def run(s: SparkSession, d: str) -> DataFrame:
        pts = table(s, d, "customer").where("c_custkey <= 700").select(F.col("c_custkey").alias("rid"), (F.col("c_custkey") * 37 % 211).cast("double").alias("x"), F.round(F.col("c_acctbal") / 100, 3).alias("y"))
        return G.grid_edges(pts, 6.0)

    return run, """WITH p AS (SELECT c_custkey AS rid, (c_custkey * 37 % 211)::DOUBLE AS x, round(c_acctbal / 100, 3) AS y FROM customer WHERE c_custkey <= 700)
      SELECT a.rid AS a, b.rid AS b FROM p a JOIN p b ON a.rid < b.rid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 36"""


def places_of_a_support() -> Made:
    """Cohesion of a support over the neighbour graph that an extension makes of the places."""

    def run(s: SparkSession, d: str) -> DataFrame:
        from ..operators.extensions import Extended

        c = table(s, d, "customer").where("c_custkey <= 700").select(F.col("c_custkey").alias("rid"), (F.col("c_custkey") * 37 % 211).cast("double").alias("x"), F.round(F.col("c_acctbal") / 100, 3).alias("y"), "c_mktsegment", "c_nationkey")
        queries = parse("c_mktsegment={BUILDING,MACHINERY}"), parse("[c_nationkey<15]")
        return Extended(c).add("geo", reach=6.0).metric("geo", "cohesion", queries)

    return run, """WITH p AS (SELECT c_custkey AS rid, (c_custkey * 37 % 211)::DOUBLE AS x, round(c_acctbal / 100, 3) AS y, c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey <= 15 AS s FROM customer WHERE c_custkey <= 700),
      e AS (SELECT a.s AS p, b.s AS q FROM p a JOIN p b ON a.rid < b.rid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 36),
      c AS (SELECT count(*) FILTER (p AND q) AS n_inner, count(*) FILTER (p <> q) AS n_outer FROM e) SELECT *, CASE WHEN n_inner + n_outer > 0 THEN n_inner / (n_inner + n_outer) ELSE 0.0 END AS cohesion FROM c"""


def streamed_parts() -> Made:
    """Part counts over a stream of aligned rows, after all of it has come."""
    pairs = [(LEFT, RIGHT), (WIDE, RIGHT)]

    def run(s: SparkSession, d: str) -> DataFrame:
        path, name = folder(s), f"parts_{uuid.uuid4().hex}"
        sides(s, d).select("rid", "status", "price", "priority", "returned").write.parquet(path)
        stream = s.readStream.schema(s.read.parquet(path).schema).parquet(path)
        q = streaming_parts(stream, pairs).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        q.awaitTermination()
        return s.table(name).select("pair", "part", "n")

    rows = " UNION ALL ".join(f"SELECT {i} AS pair, {part_sql(l, r)} AS part FROM t" for i, (l, r) in enumerate(pairs))
    return run, T + f"SELECT pair, part, count(*) AS n FROM ({rows}) GROUP BY ALL"


def missing_aware_pairs() -> Made:
    """Pairs of literals on columns with missing values, by way of counting these."""
    pairs = [(parse("priority_m=1-URGENT"), parse("open_m")), (parse("priority_m!={2-HIGH,3-MEDIUM}"), parse("!open_m & returned"))]

    def run(s: SparkSession, d: str) -> DataFrame:
        counts = evaluate(sides(s, d), pairs)
        n = {k: lengths(k) for k in ("optimistic", "pessimistic", "positive")}
        made = F.array(*(F.struct(F.lit(k).alias("kind"), v["I"].alias("n_inter"), v["U"].alias("n_union"), accuracy(k).alias("acc")) for k, v in n.items()))
        return counts.select("pair", F.explode(made).alias("e")).select("pair", "e.*")

    of = {"optimistic": ("Exx + Exm + Emx + Emm", "Exo + Eox"), "pessimistic": ("Exx", "Exo + Eox + Exm + Emx + Eom + Emo + Emm"), "positive": ("Exx + Exm + Emx + Emm", "Exo + Eox + Eom + Emo")}
    rows = " UNION ALL ".join(f"SELECT {i} AS pair, '{k}' AS kind, {a} AS n_inter, {a} + {b} AS n_union, ({a})::DOUBLE / ({a} + {b}) AS acc FROM ({counts_sql(l, r)})" for i, (l, r) in enumerate(pairs) for k, (a, b) in of.items())
    return run, T + rows


ALL: dict[str, Callable[[], Made]] = {
    f.__name__: f
    for f in (
        csv_dense, csv_plain, csv_forced_kinds, sparse_import, sparse_pairs, special_columns, coordinates_file, metadata_rows, import_both_sides, transactions_file, redescription_text, pairs_cache, package_round_trip,
        result_supports, parameters_file, time_bound, derived_literals, kleene_truth, query_probability, rewritten_queries, shown_queries, masks, category_literals, align_by_position, numbered_rows, single_table_pairs,
        unseen_pairs, pvalue_of_supports, overlap_of_areas, part_moves, sorted_items, filtered_items, first_of_each_left, unlike_the_first, candidate_orders, selection_pipeline, weighted_scores, best_of_each_column,
        double_negations, fields_of_items, collapsed_buckets, tail_buckets, least_error_segments, buckets_by_edges, best_negative_interval, same_thresholds, rounded_thresholds, category_sets, searched_pairs, searched_extensions,
        one_generation, filled_holes, pruned_and_improved, found_condition, tree_stump, first_layer, run_signatures, literal_rows, derived_columns, possible_columns, random_folds, equal_folds, grouped_folds, folds_of_a_column,
        folded_run, permuted_side, shuffled_traits, swapped_sums, rows_of_a_redescription, hops, near_places, places_of_a_support, streamed_parts, missing_aware_pairs,
    )
} | {"similar_height_buckets": similar_height}
