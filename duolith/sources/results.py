"""Redescriptions as text, cached pairs, packages, and fields to print."""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession

from ..expressions import parse, show
from ..operators.support import PARTS

COLUMNS = ("rid", "query_LHS", "query_RHS", "query_COND", "acc", "pval", *(f"card_{p}" for p in PARTS))
#: Digits of the numbers that are shown.
DIGITS = {"acc": 3, "pval": 3, "perc": 2, "ratio": 4}


def to_rows(items: Sequence[dict], style: str = "text", names: dict[str, str] | None = None) -> list[tuple]:
    return [
        (f"r{i}", show(x["queries"][0], style, names), show(x["queries"][1], style, names), show(x["cond"], style, names) if x.get("cond") else "", float(x["acc"]), float(x.get("pval", math.nan)), *(int(x.get(p, 0)) for p in PARTS))
        for i, x in enumerate(items)
    ]


SCHEMA = "rid string, query_LHS string, query_RHS string, query_COND string, acc double, pval double, " + ", ".join(f"card_{p} long" for p in PARTS)


def write_redescriptions(spark: SparkSession, items: Sequence[dict], path: str, **how) -> None:
    spark.createDataFrame(to_rows(items, **how), SCHEMA).coalesce(1).write.csv(path, sep="\t", header=True)


def read_redescriptions(spark: SparkSession, path: str) -> list[dict]:
    rows = spark.read.csv(path, sep="\t", header=True, schema=SCHEMA).collect()
    return [{"queries": (parse(r["query_LHS"] or ""), parse(r["query_RHS"] or "")), "cond": parse(r["query_COND"]) if r["query_COND"] else None, "acc": r["acc"], "pval": r["pval"], **{p: r[f"card_{p}"] for p in PARTS}} for r in rows]


def tex_table(items: Sequence[dict], names: dict[str, str] | None = None) -> str:
    lines = [rf"${show(x['queries'][0], 'tex', names)}$ & ${show(x['queries'][1], 'tex', names)}$ & {x['acc']:.{DIGITS['acc']}f} \\" for x in items]
    return "\n".join([r"\begin{tabular}{llr}", *lines, r"\end{tabular}"])


def save_pairs(spark: SparkSession, items: Sequence[dict], path: str) -> None:
    """Initial pairs with whether they were explored, so that a run can go on."""
    rows = [(show(x["queries"][0]), show(x["queries"][1]), float(x["acc"]), bool(x.get("done", False)), *(int(x.get(p, 0)) for p in PARTS)) for x in items]
    spark.createDataFrame(rows, "left string, right string, acc double, done boolean, " + ", ".join(f"{p} long" for p in PARTS)).write.mode("overwrite").parquet(path)


def load_pairs(spark: SparkSession, path: str, all_pairs: bool = False) -> list[dict]:
    rows = spark.read.parquet(path).orderBy("acc", ascending=False).collect()
    return [{"queries": (parse(r["left"]), parse(r["right"])), "acc": r["acc"], "done": r["done"], **{p: r[p] for p in PARTS}} for r in rows if all_pairs or not r["done"]]


def save_package(spark: SparkSession, path: str, left: DataFrame, right: DataFrame, items: Sequence[dict], settings, name: str = "package") -> None:
    """Both sides, the redescriptions and a manifest with the settings, under one folder."""
    left.write.parquet(f"{path}/left")
    right.write.parquet(f"{path}/right")
    write_redescriptions(spark, items, f"{path}/redescriptions")
    manifest = json.dumps({"name": name, "settings": asdict(settings) if is_dataclass(settings) else dict(settings)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load_package(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[dict], dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    return spark.read.parquet(f"{path}/left"), spark.read.parquet(f"{path}/right"), read_redescriptions(spark, f"{path}/redescriptions"), manifest


def write_results(spark: SparkSession, df: DataFrame, items: Sequence[dict], path: str, names: dict[str, str] | None = None, rid: str = "rid") -> None:
    """Three tables: queries, queries with names, and the rows of each part of each redescription."""
    from pyspark.sql import functions as F

    from ..expressions import to_column
    from ..operators.support import part

    write_redescriptions(spark, items, f"{path}/queries")
    write_redescriptions(spark, items, f"{path}/named", names=names)
    marks = [F.struct(F.lit(f"r{i}").alias("red"), part(*(to_column(q) for q in x["queries"])).alias("part")) for i, x in enumerate(items)]
    df.select(rid, F.explode(F.array(*marks)).alias("m")).select("m.red", "m.part", rid).where("part <> 'Eoo'").write.partitionBy("red").parquet(f"{path}/support")


# Fields: rset:what:which over the statistics of a set of rows, and arithmetic of them.
def field(item: dict, address: str):
    """The value of rset:what:which. rset: empty or active, or a name of item['sets'] (learn, test, cond), or a side (LHS, RHS, BOTH) for lengths
    of queries; what: acc, pval, len, perc, ratio or query; which: a letter, a part, or q for a query's length."""
    rset, what, which = (address.split(":") + ["", ""])[:3]
    from ..expressions import length, variables

    sides = {"LHS": [0], "0": [0], "RHS": [1], "1": [1], "BOTH": [0, 1]}
    if rset in sides and (which == "q" or what == "query"):
        queries = [item["queries"][s] for s in sides[rset]]
        return sum(map(length, queries)) if what == "len" else " / ".join(map(show, queries)) if what == "query" else sorted(set().union(*map(variables, queries)))
    stats = item if rset in ("", "all", "active") else item.get("sets", {}).get(rset, {})
    n = sum(stats.get(p, 0) for p in PARTS)
    letters = {"I": ("Exx",), "U": ("Exx", "Exo", "Eox"), "L": ("Exx", "Exo"), "R": ("Exx", "Eox"), "O": ("Eoo",), "A": ("Exo",), "B": ("Eox",), "D": ("Exo", "Eox"), "N": PARTS}
    if what in ("len", "perc", "ratio"):
        size = sum(stats.get(p, 0) for p in letters.get(which, (which,)))
        return size if what == "len" else None if not n else size / n * (100 if what == "perc" else 1)
    return stats.get(what)


_BINARY: dict[type, Callable] = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: (a / b if b != 0 else math.inf)}


def derived(item: dict, expression: str):
    """Arithmetic over fields in braces, as {test:acc:} / {learn:acc:}; division by 0 is infinite, and an unknown field makes it None."""
    values: list = []

    def name(m) -> str:
        values.append(field(item, m[1]))
        return f"_{len(values) - 1}"

    import re

    tree = ast.parse(re.sub(r"\{([^}]*)\}", name, expression), mode="eval").body

    def go(node):
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](go(node.left), go(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -go(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.Name) and node.id[1:].isdigit():
            return values[int(node.id[1:])]
        raise ValueError(f"not allowed in a field: {expression}")

    try:
        return go(tree)
    except TypeError:
        return None


def shown(value, what: str):
    return round(value, DIGITS[what]) if isinstance(value, float) and what in DIGITS and math.isfinite(value) else value
