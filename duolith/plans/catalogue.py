"""The registered queries and the SQL that gives the same rows.

The sides are orders and, for each order, what its lineitems come to; both are aligned by the order key. Columns with _m have
missing values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..expressions import INF, Bool, Cat, Group, Node, Num, extend, length, parse, show, to_column
from ..operators import extend as X
from ..operators import folds as K
from ..operators import graph as G
from ..operators import itemsets as I
from ..operators import literals as L
from ..operators import lsh as H
from ..operators import pairs as P
from ..operators import select as S
from ..operators.align import CATEGORICAL, align, cells, matrix, row_and_column_sums, subset, trait_means, weighted
from ..operators.support import PARTS, TYPES, accuracy, area, default_type, evaluate, lengths, overlap, part, support, supports_per_branch, with_pvalues
from ..sources import tables as T_
from . import miner as M

Query = Callable[[SparkSession, str], DataFrame]


def sides(spark: SparkSession, d: str) -> DataFrame:
    """The aligned rows. Each table is read once, with the columns that a query needs."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    left = orders.select(F.col("o_orderkey").alias("rid"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority_m"), F.col("o_totalprice").alias("price"))
    items = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("rid"))
    opened = F.bool_or(F.col("l_linestatus") == "O")
    right = items.agg(
        F.sum("l_quantity").alias("qty"), F.max("l_extendedprice").alias("top_price"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"),
        F.when(F.count("*") > 1, opened).alias("open_m"), F.min("l_returnflag").alias("flag"), F.count("*").alias("lines"),
    )
    return align(left, right, ["rid"])


T = """WITH lhs AS (
  SELECT o_orderkey AS rid, o_orderstatus AS status, o_orderpriority AS priority, nullif(o_orderpriority, '5-LOW') AS priority_m, o_totalprice AS price FROM orders
), rhs AS (
  SELECT l_orderkey AS rid, sum(l_quantity) AS qty, max(l_extendedprice) AS top_price, bool_or(l_returnflag = 'R') AS returned,
    CASE WHEN count(*) > 1 THEN bool_or(l_linestatus = 'O') END AS open_m, min(l_returnflag) AS flag, count(*) AS lines
  FROM lineitem GROUP BY l_orderkey
), t AS MATERIALIZED (SELECT * FROM lhs JOIN rhs USING (rid))
"""


def sql_of(node: Node) -> str:
    """The SQL text of a query."""
    if isinstance(node, Group):
        out = f" {node.op.upper()} ".join(f"({sql_of(x)})" for x in node.items) or "true"
    elif isinstance(node, Bool):
        out = node.var
    elif isinstance(node, Cat):
        out = f"{node.var} IN ({', '.join(repr(v) for v in node.values)})"
    else:
        out = " AND ".join([f"{node.var} >= {node.low!r}"] * (node.low > -INF) + [f"{node.var} <= {node.high!r}"] * (node.high < INF))
    return f"NOT ({out})" if node.neg else out


LEFT, RIGHT = parse("status=F"), parse("returned")
LEFT_M, RIGHT_M = parse("priority_m={1-URGENT,2-HIGH}"), parse("open_m")
WIDE = parse("(status=F & [price<200000.5]) | priority=1-URGENT")
LEFTS = [Cat("status", (s,)) for s in "FOP"] + [Cat("priority", (p,)) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")] + [Num("price", -INF, 100_000.0), Num("price", 250_000.0, INF)]
RIGHTS = [Bool("returned")] + [Cat("flag", (s,)) for s in "ANR"] + [Num("qty", -INF, 50.0), Num("qty", 50.0, 150.0), Num("qty", 150.0, INF), Num("top_price", 40_000.0, INF)]
#: For each band and row of a band; fixed, so that the SQL can repeat them.
COEFFS = [[(7 + 13 * i, 11 + 29 * i), (101 + 17 * i, 5 + 31 * i)] for i in range(6)]
PRIME = 1_000_003
CANDIDATES = [Num("qty", 100.0, INF), Cat("flag", ("A", "R")), Num("lines", 1.0, 3.0), Num("top_price", -INF, 50_000.0)]
EDGES = (0, 30, 60, 100, 150, 220)
GROUPS = {"price": 1, "qty": 1, "status": 2, "flag": 3, "returned": -1}

PART = """CASE WHEN {0} THEN 'Ex' WHEN NOT ({0}) THEN 'Eo' ELSE 'Em' END || CASE WHEN {1} THEN 'x' WHEN NOT ({1}) THEN 'o' ELSE 'm' END"""


def part_sql(l: Node, r: Node) -> str:
    return PART.format(f"({sql_of(l)})", f"({sql_of(r)})")


def counts_sql(l: Node, r: Node, where: str = "true") -> str:
    return f"SELECT {', '.join(f'count(*) FILTER (part = {p!r}) AS {p}' for p in PARTS)} FROM (SELECT {part_sql(l, r)} AS part FROM t WHERE {where})"


def added(names) -> str:
    return " + ".join(names) or "0"


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END ELSE ({a})::DOUBLE / ({b}) END"


def long_counts(df: DataFrame) -> DataFrame:
    """part, n from one row of counts."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("n")) for p in PARTS))).alias("e")).select("e.*")


def _support(query: Node) -> tuple[Query, str]:
    c = sql_of(query)
    return lambda s, d: support(sides(s, d), query), T + f"SELECT count(*) FILTER ({c}) AS n_true, count(*) FILTER (({c}) IS NULL) AS n_missing, count(*) FILTER (NOT ({c})) AS n_false FROM t"


def _parts(l: Node, r: Node, names: tuple[str, ...]) -> tuple[Query, str]:
    run = lambda s, d: long_counts(evaluate(sides(s, d), [(l, r)])).where(F.col("part").isin(*names))
    rows = " UNION ALL ".join(f"SELECT '{p}' AS part, {p} AS n FROM c" for p in names)
    return run, T + f", c AS ({counts_sql(l, r)}) {rows}"


def align_sides() -> tuple[Query, str]:
    return lambda s, d: sides(s, d).select("rid", "status", "qty"), T + "SELECT rid, status, qty FROM t"


def jaccard_by_part_type() -> tuple[Query, str]:
    kinds = [k for k in TYPES if k != "none"]

    def run(s: SparkSession, d: str) -> DataFrame:
        counts = evaluate(sides(s, d), [(LEFT_M, RIGHT_M)], default_type(True))
        return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("part_type"), accuracy(k).alias("acc")) for k in kinds))).alias("e")).select("e.*")

    rows = " UNION ALL ".join(f"SELECT '{k}' AS part_type, {ratio_sql(added(TYPES[k][0]), added(TYPES[k][0] + TYPES[k][1]))} AS acc FROM c" for k in kinds)
    return run, T + f", c AS ({counts_sql(LEFT_M, RIGHT_M)}) {rows}"


def lens_piulroabn() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        n = lengths()
        counts = evaluate(sides(s, d), [(LEFT, RIGHT)])
        every = F.array(*(F.struct(F.lit(k).alias("letter"), v.alias("n"), (v * 100 / n["N"]).alias("perc")) for k, v in n.items()))
        return counts.select(F.explode(every).alias("e")).select("e.*")

    of = {"I": "Exx", "U": "Exx + Exo + Eox", "L": "Exx + Exo", "R": "Exx + Eox", "O": "Eoo", "D": "Exo + Eox", "A": "Exo", "B": "Eox", "N": added(PARTS)}
    rows = " UNION ALL ".join(f"SELECT '{k}' AS letter, {v} AS n, ({v}) * 100 / ({of['N']}) AS perc FROM c" for k, v in of.items())
    return run, T + f", c AS ({counts_sql(LEFT, RIGHT)}) {rows}"


def _atoms(l: str, r: str) -> tuple[Query, str]:
    run = lambda s, d: P.score_atoms(P.contingency(sides(s, d), F.expr(l), F.expr(r)), min_in=5)
    sql = f""", c AS (SELECT {l} AS l, {r} AS r, count(*) AS n FROM t GROUP BY ALL),
      m AS (SELECT l, r, n AS n_inter, (sum(n) OVER (PARTITION BY l) + sum(n) OVER (PARTITION BY r) - n)::BIGINT AS n_union FROM c)
      SELECT l, r, n_inter, n_union, n_inter::DOUBLE / n_union AS acc FROM m WHERE l IS NOT NULL AND r IS NOT NULL AND n_inter >= 5"""
    return run, T + sql


def _intervals(l: str, r: str, atom: bool) -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        return P.score_intervals(P.contingency(sides(s, d), F.expr(l), F.expr(r)), min_in=5, atom=atom)

    runs = "a.l = b.l" if atom else "a.l <= b.l"
    sql = f""", x AS MATERIALIZED (SELECT {l} AS l, {r} AS r FROM t),
      ls AS (SELECT DISTINCT l FROM x WHERE l IS NOT NULL), rs AS (SELECT DISTINCT r FROM x WHERE r IS NOT NULL),
      k AS (SELECT a.l AS l_low, b.l AS l_high, c.r AS r_low, e.r AS r_high FROM ls a JOIN ls b ON {runs} CROSS JOIN rs c JOIN rs e ON c.r <= e.r),
      n AS (SELECT k.*, count(*) FILTER (x.l BETWEEN l_low AND l_high AND x.r BETWEEN r_low AND r_high) AS n_inter,
        count(*) FILTER (x.l BETWEEN l_low AND l_high OR x.r BETWEEN r_low AND r_high) AS n_union FROM k CROSS JOIN x GROUP BY ALL)
      SELECT *, n_inter::DOUBLE / n_union AS acc FROM n WHERE n_inter >= 5"""
    return run, T + sql


def all_pairs() -> list[tuple[Node, Node]]:
    return [(l, r) for l in LEFTS for r in RIGHTS]


def named_pairs(s: SparkSession, d: str) -> DataFrame:
    rows = evaluate(sides(s, d), all_pairs())
    names = F.array(*(F.struct(F.lit(show(l)).alias("left"), F.lit(show(r)).alias("right")) for l, r in all_pairs()))
    return rows.select(F.col("pair").cast("long").alias("pid"), F.get(names, F.col("pair")).alias("n"), "acc", F.col("Exx").alias("n_inter")).select("pid", "n.left", "n.right", "acc", "n_inter")


def pairs_sql() -> str:
    """pid, left, right, acc, n_inter of all pairs, one scan."""
    cols = ", ".join(f"count(*) FILTER (({sql_of(l)}) AND ({sql_of(r)})) AS i{k}, count(*) FILTER (({sql_of(l)}) OR ({sql_of(r)})) AS u{k}" for k, (l, r) in enumerate(all_pairs()))
    rows = " UNION ALL ".join(f"""SELECT {k}::BIGINT AS pid, '{show(l)}' AS "left", '{show(r)}' AS "right", {ratio_sql(f'i{k}', f'u{k}')} AS acc, i{k} AS n_inter FROM w""" for k, (l, r) in enumerate(all_pairs()))
    return f", w AS (SELECT {cols} FROM t), p AS ({rows})"


def topk_pairs_ties() -> tuple[Query, str]:
    run = lambda s, d: P.top_with_ties(named_pairs(s, d).where("n_inter >= 10"), 10, F.desc("acc"))
    return run, T + pairs_sql() + "SELECT * EXCLUDE rank FROM (SELECT *, rank() OVER (ORDER BY acc DESC) AS rank FROM p WHERE n_inter >= 10) WHERE rank <= 10"


def alternate_ranking() -> tuple[Query, str]:
    run = lambda s, d: P.ranked(named_pairs(s, d), "alternate").select("pid", "place")
    sql = """, r AS (SELECT *, acc - greatest(row_number() OVER (PARTITION BY "left" ORDER BY acc DESC, pid) - 1, row_number() OVER (PARTITION BY "right" ORDER BY acc DESC, pid) - 1) AS k FROM p)
      SELECT pid, row_number() OVER (ORDER BY k DESC, pid)::INTEGER AS place FROM r"""
    return run, T + pairs_sql() + sql


def _extend(op: str, neg: bool) -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        parts = X.literal_parts(sides(s, d), LEFT, RIGHT, CANDIDATES)
        out = X.score_extensions(parts, 1, ops=(op,), negations=(neg,), min_contribution=-(10**9))
        return out.select("lit", F.col("Exx").alias("n_inter"), (F.col("Exx") + F.col("Exo") + F.col("Eox")).alias("n_union"), "acc")

    rows = []
    for k, c in enumerate(CANDIDATES):
        lit = Group("and", (c,), neg)
        new = extend(RIGHT, op, lit)
        l, r = f"({sql_of(LEFT)})", f"({sql_of(new)})"
        rows.append(f"SELECT {k} AS lit, count(*) FILTER ({l} AND {r}) AS n_inter, count(*) FILTER ({l} OR {r}) AS n_union FROM t")
    return run, T + f"SELECT *, n_inter::DOUBLE / n_union AS acc FROM ({' UNION ALL '.join(rows)}) WHERE n_inter >= 1"


def numeric_part_histogram() -> tuple[Query, str]:
    run = lambda s, d: L.part_histogram(sides(s, d), "lines", part(to_column(LEFT), to_column(RIGHT)))
    return run, T + f"SELECT lines AS value, {part_sql(LEFT, RIGHT)} AS part, count(*) AS n FROM t GROUP BY ALL"


def _histogram(s: SparkSession, d: str) -> DataFrame:
    return L.part_histogram(sides(s, d), "qty", part(to_column(LEFT), to_column(RIGHT)))


# Joining a literal to the right side by and: rows of Exx stay in the intersection, rows of Eox stay in the union.
_BLOCKS = f""", h AS (SELECT qty AS value, count(*) FILTER (part = 'Exx') AS num, count(*) FILTER (part = 'Eox') AS den
    FROM (SELECT qty, {part_sql(LEFT, RIGHT)} AS part FROM t) GROUP BY qty),
  k AS (SELECT *, CASE WHEN num = 0 THEN 'den' WHEN den = 0 THEN 'num' ELSE 'both' END AS kind FROM h WHERE num + den > 0),
  s AS (SELECT *, CASE WHEN kind = 'both' OR kind IS DISTINCT FROM lag(kind) OVER (ORDER BY value) THEN 1 ELSE 0 END AS start FROM k),
  b AS (SELECT *, sum(start) OVER (ORDER BY value) - 1 AS block FROM s),
  blocks AS MATERIALIZED (SELECT block::BIGINT AS block, min(value) AS low, max(value) AS high, sum(num)::BIGINT AS num, sum(den)::BIGINT AS den FROM b GROUP BY block)
"""


def cutpoint_blocks() -> tuple[Query, str]:
    return lambda s, d: L.pure_blocks(_histogram(s, d), ["Exx"], ["Eox"]), T + _BLOCKS + "SELECT * FROM blocks"


def best_interval_prefix_sums() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        outside = evaluate(sides(s, d), [(LEFT, RIGHT)]).first()
        # rows of the left side alone and those of both that the literal would lose are in the union by the left query
        blocks = L.pure_blocks(_histogram(s, d), ["Exx"], ["Eox"])
        return L.best_interval(blocks, 0, outside["Exo"], min_in=10)

    sql = f""", o AS (SELECT count(*) AS exo FROM (SELECT {part_sql(LEFT, RIGHT)} AS part FROM t) WHERE part = 'Exo'),
      c AS (SELECT a.low, z.high, a.block AS i, z.block AS j, sum(m.num)::BIGINT AS num, sum(m.den)::BIGINT AS den FROM blocks a JOIN blocks z ON a.block <= z.block JOIN blocks m ON m.block BETWEEN a.block AND z.block GROUP BY ALL)
      SELECT low, high, num, den, num::DOUBLE / (exo + num + den) AS acc FROM c, o WHERE num + den >= 10 ORDER BY acc DESC, j - i, i LIMIT 1"""
    return run, T + _BLOCKS + sql


def equal_width_buckets() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d).select("price")
        ends = rows.agg(F.min("price").alias("a"), F.max("price").alias("b")).first()
        return rows.groupBy(L.equal_width(F.col("price"), ends["a"], ends["b"], 12).alias("bucket")).agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))

    return run, T + ", e AS (SELECT min(price) AS a, max(price) AS b FROM t) SELECT least(floor((price - a) * 12 / (b - a)), 11)::INTEGER AS bucket, count(*) AS n, min(price) AS low, max(price) AS high FROM t, e GROUP BY 1"


def _literal_supports(s: SparkSession, d: str) -> DataFrame:
    return M.Data(sides(s, d), (LEFTS, RIGHTS), n=1).supports()


_SUPPORTS = ", s AS (" + " UNION ALL ".join(f"SELECT {k} AS side, {i} AS lit, rid FROM t WHERE {sql_of(x)}" for k, lits in enumerate((LEFTS, RIGHTS)) for i, x in enumerate(lits)) + ")"
_MINS = ", ".join(f"[{', '.join(f'min(({a} * rid + {b}) % {PRIME})' for a, b in band)}]" for band in COEFFS)


def minhash_signatures() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        out = H.in_bands(H.signatures(_literal_supports(s, d), COEFFS, PRIME), "side", "lit", "n")
        return out.select("side", "lit", "n", "band", F.concat_ws(",", F.transform("sig", lambda x: x.cast("string"))).alias("sig"))

    return run, T + _SUPPORTS + f", g AS (SELECT side, lit, count(*) AS n, [{_MINS}] AS sig FROM s GROUP BY side, lit), b AS (SELECT side, lit, n, unnest(range({len(COEFFS)}))::INTEGER AS band, sig FROM g) SELECT side, lit, n, band, array_to_string(sig[band + 1], ',') AS sig FROM b"


def lsh_band_candidates() -> tuple[Query, str]:
    run = lambda s, d: H.candidates(H.signatures(_literal_supports(s, d), COEFFS, PRIME))
    sql = f""", g AS (SELECT side, lit, [{_MINS}] AS sig FROM s GROUP BY side, lit), b AS (SELECT side, lit, unnest(range({len(COEFFS)})) AS band, sig FROM g), c AS (SELECT side, lit, band, sig[band + 1] AS sig FROM b)
      SELECT x.lit AS "left", y.lit AS "right", count(*) AS n_bands FROM c x JOIN c y ON x.side = 0 AND y.side = 1 AND x.band = y.band AND x.sig = y.sig GROUP BY ALL"""
    return run, T + _SUPPORTS + sql


def lsh_extension_candidates() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        signed = H.signatures(_literal_supports(s, d), COEFFS, PRIME)
        return H.extensions(sides(s, d), LEFT, RIGHT, signed, COEFFS, PRIME)

    l, r = sql_of(LEFT), sql_of(RIGHT)
    sql = f""", q AS (SELECT 'and' AS target, rid FROM t WHERE ({l}) AND ({r}) UNION ALL SELECT 'or', rid FROM t WHERE ({l}) OR ({r})),
      u AS (SELECT target, -1 AS side, -1 AS lit, rid FROM q UNION ALL SELECT NULL, side, lit, rid FROM s),
      g AS (SELECT target, side, lit, [{_MINS}] AS sig FROM u GROUP BY ALL), b AS (SELECT *, unnest(range({len(COEFFS)})) AS band FROM g), c AS (SELECT target, side, lit, band, sig[band + 1] AS sig FROM b)
      SELECT x.target, y.side, y.lit, count(*) AS n_bands FROM c x JOIN c y ON x.side = -1 AND y.side >= 0 AND x.band = y.band AND x.sig = y.sig GROUP BY ALL"""
    return run, T + _SUPPORTS + sql


_KINDS = {"status": 2, "priority": 2, "priority_m": 2, "price": 3}
_KINDS_R = {"returned": 1, "open_m": 1, "flag": 2, "qty": 3, "lines": 3}


def _long(s: SparkSession, d: str) -> DataFrame:
    rows = sides(s, d)
    return cells(rows, "rid", 0, _KINDS).unionByName(cells(rows, "rid", 1, _KINDS_R))


def usable_columns() -> tuple[Query, str]:
    run = lambda s, d: L.usable(_long(s, d), 100, 700)
    rows = []
    for side, of in ((0, _KINDS), (1, _KINDS_R)):
        for c, k in of.items():
            if k == 1:
                rows.append(f"SELECT {side} AS side, '{c}' AS cid, 1 AS kind FROM t HAVING count(*) FILTER ({c}) >= 100 AND count(*) - count(*) FILTER ({c}) >= 700")
            elif k == 2:
                rows.append(f"SELECT DISTINCT {side} AS side, '{c}' AS cid, 2 AS kind FROM (SELECT {c}, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c}), (SELECT count(*) AS total FROM t) WHERE n >= 100 AND total - n >= 700")
            else:
                rows.append(f"SELECT DISTINCT {side} AS side, '{c}' AS cid, 3 AS kind FROM (SELECT {c}, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c}), (SELECT count(*) AS total FROM t) WHERE total - n >= 100 OR total - n <= total - 700")
    return run, T + " UNION ALL ".join(rows)


def group_compatible_pairs() -> tuple[Query, str]:
    catalog = [(0, c, k, GROUPS.get(c)) for c, k in _KINDS.items()] + [(1, c, k, GROUPS.get(c)) for c, k in _KINDS_R.items()]
    run = lambda s, d: P.column_pairs(s.createDataFrame(catalog, "side int, cid string, kind int, gid int"))
    values = ", ".join(f"({s}, '{c}', {k}, {g if g is not None else 'NULL'})" for s, c, k, g in catalog)
    return run, f"""WITH c(side, cid, kind, gid) AS (VALUES {values}) SELECT a.cid AS "left", b.cid AS "right", a.kind AS kind_l, b.kind AS kind_r FROM c a JOIN c b ON a.side = 0 AND b.side = 1 AND (coalesce(a.gid, -1) = -1 OR coalesce(b.gid, -1) = -1 OR a.gid <> b.gid)"""


def overlap_rows_ratio() -> tuple[Query, str]:
    other = (parse("priority=1-URGENT | status=F"), parse("[qty>100]"))
    run = lambda s, d: overlap(sides(s, d), (LEFT, RIGHT), other)
    x, y = (f"(({sql_of(a)}) AND ({sql_of(b)}))" for a, b in ((LEFT, RIGHT), other))
    sql = f"SELECT count(*) FILTER ({x} AND {y}) AS n_inter, count(*) FILTER ({x} OR {y}) AS n_union, least(count(*) FILTER ({x}), count(*) FILTER ({y})) AS n_least FROM t"
    return run, T + f", o AS ({sql}) SELECT n_inter, n_union, {ratio_sql('n_inter', 'n_union')} AS ratio, {ratio_sql('n_inter', 'n_least')} AS fract_min FROM o"


def area_metrics() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        n = lengths()
        counts = evaluate(sides(s, d), [(WIDE, RIGHT)])
        both = Group("and", (WIDE, RIGHT))
        return counts.select(area(WIDE, n["L"]).alias("area_left"), area(RIGHT, n["R"]).alias("area_right"), area(both, n["I"]).alias("area_inter"), area(both, n["U"]).alias("area_union"))

    k, m = length(WIDE), length(RIGHT)
    return run, T + f", c AS ({counts_sql(WIDE, RIGHT)}) SELECT {k} * (Exx + Exo) AS area_left, {m} * (Exx + Eox) AS area_right, {k + m} * Exx AS area_inter, {k + m} * (Exx + Exo + Eox) AS area_union FROM c"


def prune_minus_one() -> tuple[Query, str]:
    variants = [(WIDE, RIGHT), *X.minus_one_variants((WIDE, RIGHT))]
    run = lambda s, d: evaluate(sides(s, d), variants).select("pair", F.col("Exx").alias("n_inter"), "acc")
    rows = " UNION ALL ".join(f"SELECT {i} AS pair, count(*) FILTER (({sql_of(l)}) AND ({sql_of(r)})) AS n_inter, count(*) FILTER (({sql_of(l)}) AND ({sql_of(r)}))::DOUBLE / count(*) FILTER (({sql_of(l)}) OR ({sql_of(r)})) AS acc FROM t" for i, (l, r) in enumerate(variants))
    return run, T + rows


def condition_accuracy() -> tuple[Query, str]:
    conditions = [parse("priority=1-URGENT"), parse("[price>150000]"), parse("[lines<3] & priority!=5-LOW")]
    run = lambda s, d: X.conditioned(sides(s, d), (LEFT, RIGHT), conditions)
    l, r = sql_of(LEFT), sql_of(RIGHT)
    rows = " UNION ALL ".join(f"SELECT {i} AS cond, count(*) FILTER (({l}) AND ({r})) AS n_inter, count(*) FILTER (({l}) OR ({r})) AS n_union FROM t WHERE {sql_of(c)}" for i, c in enumerate(conditions))
    return run, T + f"SELECT *, {ratio_sql('n_inter', 'n_union')} AS acc FROM ({rows})"


def fold_accuracy_ratio() -> tuple[Query, str]:
    run = lambda s, d: K.fold_accuracies(sides(s, d).withColumn("fold", F.col("rid") % 5), (LEFT, RIGHT))
    l, r = sql_of(LEFT), sql_of(RIGHT)
    sql = f", f AS (SELECT rid % 5 AS fold, count(*) FILTER (({l}) AND ({r})) AS i, count(*) FILTER (({l}) OR ({r})) AS u FROM t GROUP BY 1), a AS (SELECT fold, i, u, sum(i) OVER () - i AS li, sum(u) OVER () - u AS lu FROM f), b AS (SELECT fold, {ratio_sql('li', 'lu')} AS acc_learn, {ratio_sql('i', 'u')} AS acc_test FROM a)"
    return run, T + sql + f" SELECT *, {ratio_sql('acc_test', 'acc_learn')} AS acc_ratio FROM b"


def fold_spread() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        out = K.fold_summary(K.fold_accuracies(sides(s, d).withColumn("fold", F.col("rid") % 5), (LEFT, RIGHT)))
        return out.select(*(F.round(c, 9).alias(c) for c in out.columns))

    l, r = sql_of(LEFT), sql_of(RIGHT)
    return run, T + f", f AS (SELECT {ratio_sql(f'count(*) FILTER (({l}) AND ({r}))', f'count(*) FILTER (({l}) OR ({r}))')} AS a FROM t GROUP BY rid % 5) SELECT round(avg(a), 9) AS mean, round(stddev_pop(a), 9) AS std, round(min(a), 9) AS least, round(max(a), 9) AS most FROM f"


def trait_mean_query() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        nations = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").cast("long").alias("rid"), F.col("n_name").alias("var"), (F.col("n_nationkey") % 3 != 0).alias("present"))
        customers = s.read.parquet(f"{d}/customer.parquet").join(s.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
        traits = customers.groupBy(F.col("n_name").alias("var")).agg(F.count("*").cast("double").alias("customers"))
        out = trait_means(nations, traits, ["customers"])
        return out.select("rid", F.round("mean_customers", 6).alias("mean_customers"), "n_vars")

    return run, """WITH c AS (SELECT n_name, count(*)::DOUBLE AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
      SELECT n_regionkey::BIGINT AS rid, round(coalesce(avg(customers) FILTER (n_nationkey % 3 <> 0), 0.0), 6) AS mean_customers, count(*) FILTER (n_nationkey % 3 <> 0) AS n_vars FROM nation LEFT JOIN c USING (n_name) GROUP BY 1"""


def row_weights_subset() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = weighted(sides(s, d), to_column(LEFT) & to_column(RIGHT), 3, 1).drop("copy")
        return evaluate(rows, [(LEFT, RIGHT)]).select("Exx", "Exo", "Eox", "Eoo", "acc")

    l, r = sql_of(LEFT), sql_of(RIGHT)
    return run, T + f", w AS (SELECT 3 * count(*) FILTER (({l}) AND ({r})) AS Exx, count(*) FILTER (({l}) AND NOT ({r})) AS Exo, count(*) FILTER (NOT ({l}) AND ({r})) AS Eox, count(*) FILTER (NOT ({l}) AND NOT ({r})) AS Eoo FROM t) SELECT *, Exx::DOUBLE / (Exx + Exo + Eox) AS acc FROM w"


def row_subset() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d)
        mapping = rows.select(F.col("rid").alias("old"), F.explode(F.array(F.col("rid") * 2, F.col("rid") * 2 + 1)).alias("new"))
        return subset(rows.select("rid", "status", "qty"), mapping)

    return run, T + "SELECT rid * 2 + k AS rid, status, qty FROM t, (VALUES (0), (1)) v(k)"


def final_selection() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        n = lengths()
        rows = evaluate(sides(s, d), all_pairs())
        kept = rows.where((n["I"] >= 50) & (n["O"] >= 50) & (F.col("acc") >= 0.2))
        return kept.select(F.col("pair").cast("long").alias("pid"), n["I"].alias("n_inter"), n["O"].alias("n_out"), "acc")

    cols = ", ".join(f"count(*) FILTER (({sql_of(l)}) AND ({sql_of(r)})) AS i{k}, count(*) FILTER (NOT ({sql_of(l)}) AND NOT ({sql_of(r)})) AS o{k}" for k, (l, r) in enumerate(all_pairs()))
    rows = " UNION ALL ".join(f"SELECT {k}::BIGINT AS pid, i{k} AS n_inter, o{k} AS n_out, i{k}::DOUBLE / greatest(n - o{k}, 1) AS acc FROM w" for k in range(len(all_pairs())))
    return run, T + f", w AS (SELECT count(*) AS n, {cols} FROM t) SELECT * FROM ({rows}) WHERE n_inter >= 50 AND n_out >= 50 AND acc >= 0.2"


def pvalues() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        counts = evaluate(sides(s, d), [(LEFT, RIGHT), (LEFTS[3], RIGHTS[2]), (LEFTS[7], RIGHTS[4])])
        over = with_pvalues(counts, "over").withColumnRenamed("pval", "over")
        out = with_pvalues(over, "marg").withColumnRenamed("pval", "marg")
        return out.select("pair", F.round("over", 6).alias("over"), F.round("marg", 6).alias("marg"))

    rows = " UNION ALL ".join(f"SELECT {i} AS pair, count(*) FILTER (({sql_of(l)}) AND ({sql_of(r)})) AS k, count(*) AS n, count(*) FILTER ({sql_of(l)}) AS a, count(*) FILTER ({sql_of(r)}) AS b FROM t" for i, (l, r) in enumerate([(LEFT, RIGHT), (LEFTS[3], RIGHTS[2]), (LEFTS[7], RIGHTS[4])]))
    lg = lambda x: f"(CASE WHEN {x} <= 1 THEN 0 ELSE lgamma(({x})::DOUBLE) END)"
    c = lambda n, k: f"({lg(f'{n} + 1')} - {lg(f'{k} + 1')} - {lg(f'{n} - ({k}) + 1')})"
    sql = f""", c AS ({rows}), o AS (SELECT pair, sum(exp({c('a', 'i')} + {c('(n - a)', '(b - i)')} - {c('n', 'b')})) AS over
        FROM (SELECT *, unnest(range(greatest(k, a + b - n), least(a, b) + 1)) AS i FROM c) GROUP BY pair),
      m AS (SELECT pair, sum(exp({c('n', 'i')} + i * ln(a * b / (n * n)) + (n - i) * ln(1 - a * b / (n * n)))) AS marg
        FROM (SELECT pair, n::DOUBLE AS n, a::DOUBLE AS a, b::DOUBLE AS b, unnest(range(k, n + 1)) AS i FROM c) GROUP BY pair)
      SELECT pair, round(least(over, 1.0), 6) AS over, round(least(marg, 1.0), 6) AS marg FROM o JOIN m USING (pair)"""
    return run, T + sql


def branch_supports() -> tuple[Query, str]:
    run = lambda s, d: supports_per_branch(sides(s, d), WIDE)
    return run, T + "SELECT CASE WHEN status = 'F' AND price <= 200000.5 THEN 0 WHEN priority = '1-URGENT' THEN 1 ELSE -1 END AS branch, count(*) AS n FROM t GROUP BY 1"


def column_sums() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        return row_and_column_sums(_long(s, d))[1].select("side", "cid", "n_true", "n_categories", "n_numbers", F.round("total", 2).alias("total"))

    rows = []
    for side, of in ((0, _KINDS), (1, _KINDS_R)):
        for c, k in of.items():
            rows.append(f"SELECT {side} AS side, '{c}' AS cid, {f'count(*) FILTER ({c})' if k == 1 else '0::BIGINT'} AS n_true, {f'count({c})' if k == 2 else '0::BIGINT'} AS n_categories, {f'count({c})' if k == 3 else '0::BIGINT'} AS n_numbers, {f'round(sum({c}::DOUBLE), 2)' if k == 3 else 'NULL::DOUBLE'} AS total FROM t")
    return run, T + " UNION ALL ".join(rows)


def variable_matrix() -> tuple[Query, str]:
    run = lambda s, d: matrix(sides(s, d), "rid", {"status": CATEGORICAL, "returned": 1, "qty": 3}, {"status": ["F", "O"]})
    return run, T + """SELECT rid, (status = 'F')::INTEGER::DOUBLE AS "status=F", (status = 'O')::INTEGER::DOUBLE AS "status=O", returned::INTEGER::DOUBLE AS returned, qty FROM t"""


def initial_literals() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d)
        bucket = L.by_edges(F.col("qty"), EDGES)
        buckets = rows.groupBy(bucket.alias("bucket")).agg(F.min("qty").alias("low"), F.max("qty").alias("high"), F.count("*").alias("n")).select(F.lit(1).alias("side"), F.lit("qty").alias("cid"), "bucket", "low", "high", "n")
        long = _long(s, d)
        return L.initial_literals(long, buckets, 100, 200, M.Data(rows, ((), ())).n)

    edges = " + ".join(f"(qty >= {e})::INTEGER" for e in EDGES)
    flags = [f"SELECT 1 AS side, '{c}' AS cid, 1 AS kind, NULL::VARCHAR AS category, NULL::DOUBLE AS low, NULL::DOUBLE AS high, count(*) AS n FROM t WHERE {c}" for c in ("returned", "open_m")]
    cats = [f"SELECT {s}, '{c}', 2, {c}, NULL, NULL, count(*) FROM t WHERE {c} IS NOT NULL GROUP BY {c}" for s, c in ((0, "status"), (0, "priority"), (0, "priority_m"), (1, "flag"))]
    sql = f""", k AS (SELECT {edges} - 1 AS bucket, min(qty) AS low, max(qty) AS high, count(*) AS n FROM t GROUP BY 1),
      r AS (SELECT a.low, b.high, (SELECT sum(n) FROM k WHERE bucket BETWEEN a.bucket AND b.bucket)::BIGINT AS n FROM k a JOIN k b ON a.bucket <= b.bucket),
      x AS ({' UNION ALL '.join(flags + cats)} UNION ALL SELECT 1, 'qty', 3, NULL, low, high, n FROM r)
      SELECT * FROM x WHERE n >= 100 AND n <= (SELECT count(*) FROM t) - 200"""
    return run, T + sql


def support_cohesion() -> tuple[Query, str]:
    """Customers are places; an edge joins neighbours by number in a nation. Inside are those with a positive balance."""

    def run(s: SparkSession, d: str) -> DataFrame:
        c = s.read.parquet(f"{d}/customer.parquet")
        a = c.select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("k"))
        edges = a.join(c.select(F.col("c_custkey").alias("b"), F.col("c_nationkey").alias("k"), (F.col("c_custkey") - 1).alias("a")), ["a", "k"]).select("a", "b")
        return G.cohesion(edges, c.where("c_acctbal > 0").select(F.col("c_custkey").alias("rid")))

    return run, """WITH e AS (SELECT x.c_acctbal > 0 AS p, y.c_acctbal > 0 AS q FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 AND x.c_nationkey = y.c_nationkey),
      c AS (SELECT count(*) FILTER (p AND q) AS n_inner, count(*) FILTER (p <> q) AS n_outer FROM e) SELECT *, CASE WHEN n_inner + n_outer > 0 THEN n_inner / (n_inner + n_outer) ELSE 0.0 END AS cohesion FROM c"""


def neighbour_components() -> tuple[Query, str]:
    """Customers with numbers in a row and the same market segment hang together."""

    def run(s: SparkSession, d: str) -> DataFrame:
        c = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment")
        a = c.select(F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("m"))
        b = c.select(F.col("c_custkey").alias("b"), (F.col("c_custkey") - 1).alias("a"), F.col("c_mktsegment").alias("m"))
        return G.connected_components(a.join(b, ["a", "m"]).select("a", "b"))

    return run, """WITH o AS (SELECT c_custkey AS k, c_custkey - row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS run, c_mktsegment AS m FROM customer),
      g AS (SELECT k AS node, min(k) OVER (PARTITION BY m, run) AS component, count(*) OVER (PARTITION BY m, run) AS n FROM o) SELECT node, component FROM g WHERE n > 1"""


def sparse_triples() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        return T_.to_sparse(sides(s, d).select("rid", "status", "priority_m", "returned", "open_m"), "rid")

    rows = " UNION ALL ".join(f"SELECT rid AS id, '{c}' AS cid, {c}::VARCHAR AS value FROM t WHERE {c} IS NOT NULL" for c in ("status", "priority_m", "returned", "open_m"))
    return run, T + rows


def cut_with_ties() -> tuple[Query, str]:
    """The literals of the right side by the size of their support in tens of rows: the first four, without a tie that the limit cuts."""

    def run(s: SparkSession, d: str) -> DataFrame:
        sizes = _literal_supports(s, d).groupBy("side", "lit").agg((F.count("*") / 500).cast("long").alias("size")).withColumn("id", F.col("side") * 100 + F.col("lit"))
        return S.cut_frame(sizes, 4, [F.desc("size")], -1)

    sql = """, z AS (SELECT side, lit, trunc(count(*) / 500)::BIGINT AS size, side * 100 + lit AS id FROM s GROUP BY side, lit), r AS (SELECT *, rank() OVER (ORDER BY size DESC) AS k, count(*) OVER (PARTITION BY size) AS ties FROM z)
      SELECT side, lit, size, id FROM r WHERE k + ties - 1 <= 4"""
    return run, T + _SUPPORTS + sql


def learn_test_accuracy() -> tuple[Query, str]:
    """Accuracy on the rows of a learn set and of the test set that is left."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sides(s, d)
        learn = evaluate(rows, [(LEFT, RIGHT)], restrict=F.col("rid") % 4 != 0).select(F.lit("learn").alias("rset"), *PARTS[:4], "acc")
        return learn.unionByName(evaluate(rows, [(LEFT, RIGHT)], restrict=F.col("rid") % 4 == 0).select(F.lit("test").alias("rset"), *PARTS[:4], "acc"))

    rows = " UNION ALL ".join(f"SELECT '{n}' AS rset, Exo, Eox, Exx, Eoo, Exx::DOUBLE / (Exx + Exo + Eox) AS acc FROM ({counts_sql(LEFT, RIGHT, w)})" for n, w in (("learn", "rid % 4 <> 0"), ("test", "rid % 4 = 0")))
    return run, T + rows


def itemset_redescriptions() -> tuple[Query, str]:
    def run(s: SparkSession, d: str) -> DataFrame:
        out = I.mine(I.transactions(sides(s, d), LEFTS[:8], RIGHTS[:4]), 0.05, max_length=(1, 1), min_jaccard=0.1)
        return out.select(F.get("left", F.lit(0)).alias("left"), F.get("right", F.lit(0)).alias("right"), "n_inter", "n_left", "n_right", "jaccard")

    items = " UNION ALL ".join(f"SELECT rid, '{s}' AS side, '{s}{i}' AS item FROM t WHERE {sql_of(x)}" for s, lits in (("L", LEFTS[:8]), ("R", RIGHTS[:4])) for i, x in enumerate(lits))
    sql = f""", x AS ({items}), n AS (SELECT item, count(*) AS n FROM x GROUP BY item), j AS (SELECT a.item AS l, b.item AS r, count(*) AS k FROM x a JOIN x b ON a.rid = b.rid AND a.side = 'L' AND b.side = 'R' GROUP BY ALL)
      SELECT l AS "left", r AS "right", k AS n_inter, a.n AS n_left, b.n AS n_right, k::DOUBLE / (a.n + b.n - k) AS jaccard FROM j JOIN n a ON l = a.item JOIN n b ON r = b.item
      WHERE k >= ceil(0.05::DOUBLE * (SELECT count(*) FROM t)) AND k::DOUBLE / (a.n + b.n - k) >= 0.1"""
    return run, T + sql


def mined_redescriptions() -> tuple[Query, None]:
    def run(s: SparkSession, d: str) -> DataFrame:
        data = M.Data(sides(s, d).persist(), (LEFTS, RIGHTS))
        c = M.Constraints(min_itm_in=0.05, min_itm_out=0.1, max_var_s0=2, max_var_s1=2, max_inits=3, batch_cap=2, batch_out=2)
        found = M.mine(data, c)
        data.rows.unpersist()
        rows = [(i, x["left"], x["right"], float(x["acc"]), float(x["pval"]), int(x["n_inter"])) for i, x in enumerate(found)]
        return s.createDataFrame(rows, "rank int, `left` string, `right` string, acc double, pval double, n_inter long")

    return run, None


def tree_redescriptions() -> tuple[Query, None]:
    def run(s: SparkSession, d: str) -> DataFrame:
        from ..operators.trees import alternate

        rows = sides(s, d).persist()
        steps = alternate(rows, parse("[lines>4]"), (["lines", "top_price"], ["qty", "returned"]), depth=2, rounds=4, min_leaf=20, flags=frozenset({"returned"}))
        rows.unpersist()
        return s.createDataFrame([(i, show(l), show(r), float(a)) for i, ((l, r), a) in enumerate(steps)], "step int, `left` string, `right` string, acc double")

    return run, None


_ALL: dict[str, Callable[[], tuple[Query, str | None]]] = {
    "align_sides": align_sides,
    "support_literal_bool": lambda: _support(RIGHT),
    "support_literal_cat": lambda: _support(parse("status={F,P}")),
    "support_literal_num": lambda: _support(parse("[50000<price<150000]")),
    "support_conj": lambda: _support(parse("status=F & [price>100000]")),
    "support_disj": lambda: _support(WIDE),
    "support_neg_missing": lambda: _support(parse("!(priority_m=1-URGENT | open_m)")),
    "parts_four": lambda: _parts(LEFT, RIGHT, PARTS[:4]),
    "parts_nine": lambda: _parts(LEFT_M, RIGHT_M, PARTS),
    "jaccard_by_part_type": jaccard_by_part_type,
    "lens_piulroabn": lens_piulroabn,
    "pair_bool_bool": lambda: _atoms("status = 'F'", "returned"),
    "pair_cat_cat": lambda: _atoms("status", "flag"),
    "pair_cat_num": lambda: _intervals("status", "cast(floor(qty / 60) as bigint)", True),
    "pair_num_num_buckets": lambda: _intervals("cast(floor(price / 60000) as bigint)", "cast(floor(qty / 60) as bigint)", False),
    "topk_pairs_ties": topk_pairs_ties,
    "alternate_ranking": alternate_ranking,
    "extend_and": lambda: _extend("and", False),
    "extend_or": lambda: _extend("or", False),
    "extend_negated": lambda: _extend("and", True),
    "numeric_part_histogram": numeric_part_histogram,
    "cutpoint_blocks": cutpoint_blocks,
    "best_interval_prefix_sums": best_interval_prefix_sums,
    "equal_width_buckets": equal_width_buckets,
    "minhash_signatures": minhash_signatures,
    "lsh_band_candidates": lsh_band_candidates,
    "lsh_extension_candidates": lsh_extension_candidates,
    "usable_columns": usable_columns,
    "group_compatible_pairs": group_compatible_pairs,
    "overlap_rows_ratio": overlap_rows_ratio,
    "area_metrics": area_metrics,
    "prune_minus_one": prune_minus_one,
    "condition_accuracy": condition_accuracy,
    "fold_accuracy_ratio": fold_accuracy_ratio,
    "fold_spread": fold_spread,
    "trait_means": trait_mean_query,
    "row_weights_subset": row_weights_subset,
    "row_subset": row_subset,
    "final_selection": final_selection,
    "pvalues": pvalues,
    "branch_supports": branch_supports,
    "column_sums": column_sums,
    "variable_matrix": variable_matrix,
    "initial_literals": initial_literals,
    "support_cohesion": support_cohesion,
    "neighbour_components": neighbour_components,
    "sparse_triples": sparse_triples,
    "cut_with_ties": cut_with_ties,
    "learn_test_accuracy": learn_test_accuracy,
    "itemset_redescriptions": itemset_redescriptions,
    "mined_redescriptions": mined_redescriptions,
    "tree_redescriptions": tree_redescriptions,
}


def _every() -> dict[str, Callable[[], tuple[Query, str | None]]]:
    from .catalogue_more import ALL

    return _ALL | ALL


def queries() -> dict[str, Query]:
    return {name: make()[0] for name, make in _every().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, make in _every().items() if (sql := make()[1])}
