"""Whole runs on files: mine, filter, expand, improve, folds, randomise.

python -m duolith TASK SETTINGS (JSON or XML), with the settings left, right (paths of CSV tables), key, out, and constraints by name.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..expressions import Bool, Cat, Literal
from ..operators import align as A
from ..operators import extend as X
from ..operators import folds as K
from ..operators import literals as L
from ..sources import results as R
from ..sources import tables as T
from . import miner as M


def candidate_literals(df: DataFrame, of: dict[str, int], c: M.Constraints, n: int) -> list[Literal]:
    """Literals with support within the bounds: Booleans, single categories, runs of buckets. One aggregate for each sort of column; what
    comes back are literals, not rows."""
    low, high = c.of("min_itm_in", n), n - c.of("min_itm_out", n)
    out: list[Literal] = []
    flags = [v for v, k in of.items() if k == A.BOOLEAN]
    if flags:
        row = df.agg(*(F.count_if(F.col(f"`{v}`")).alias(v) for v in flags)).first()
        out += [Bool(v) for v in flags if low <= row[v] <= high]
    words = [v for v, k in of.items() if k == A.CATEGORICAL]
    if words:
        cells = A.cells(df, "rid", 0, {v: A.CATEGORICAL for v in words}).where("s IS NOT NULL").groupBy("cid", "s").count()
        out += [Cat(r["cid"], (r["s"],)) for r in cells.where(F.col("count").between(low, high)).orderBy("cid", "s").collect()]
    numbers = [v for v, k in of.items() if k == A.NUMERICAL]
    if numbers:
        histogram = A.cells(df, "rid", 0, {v: A.NUMERICAL for v in numbers}).where("n IS NOT NULL").groupBy("cid", F.col("n").alias("value")).agg(F.count("*").alias("n"))
        by: dict[str, list] = {}
        for r in L.bucketize(histogram, c.method_buckets, c.nb_buckets).orderBy("cid", "bucket").collect():
            by.setdefault(r["cid"], []).append(r)
        for v, buckets in by.items():
            for i in range(len(buckets)):
                for j in range(i, len(buckets)):
                    if low <= sum(b["n"] for b in buckets[i : j + 1]) <= high and (x := L.interval_literal(v, [(b["low"], b["high"]) for b in buckets], i, j)):
                        out.append(x)
    return out


def read_settings(spark: SparkSession, path: str) -> dict:
    """Settings from a JSON file, or from XML with <parameter> elements that have a <name> and one or more <value>s; wherever Spark can read."""
    import xml.etree.ElementTree as tree

    # one small file, in the order of its lines
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()).strip()
    if not text.startswith("<"):
        return json.loads(text)
    if "<!" in text.replace("<!--", ""):
        raise ValueError("declarations aren't read in settings")
    known = {f.name: f.default for f in fields(M.Constraints)}
    out: dict = {}
    for p in tree.fromstring(text).iter("parameter"):
        name, values = (p.findtext("name") or "").strip(), [(v.text or "").strip() for v in p.findall("value")]
        default = known.get(name)
        if isinstance(default, bool):
            out[name] = values[0].lower() in ("true", "yes", "1")
        elif isinstance(default, tuple):
            out[name] = values
        elif isinstance(default, (int, float)):
            number = float(values[0])
            out[name] = int(number) if isinstance(default, int) and number.is_integer() else number
        else:
            out[name] = values[0] if len(values) == 1 else values
    return out


def constraints(settings: dict) -> M.Constraints:
    known = {f.name: f for f in fields(M.Constraints)}
    return M.Constraints(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items() if k in known})


def load(spark: SparkSession, settings: dict) -> tuple[M.Data, tuple[list[str], list[str]], M.Constraints]:
    """The aligned rows of both files, their literals, and the columns of either side."""
    c = constraints(settings)
    left, right, of_l, of_r = T.import_pair(spark, settings["left"], settings["right"])
    key = settings.get("key") or T.special(left, T.ID_NAMES)
    rows = A.align(left, right, [key], check=True) if key else A.align_by_position(left, right)
    rows = A.numbered(rows, "rid", [key]) if key else rows
    rows = rows.persist()
    sides = ({k: v for k, v in of_l.items() if k != key}, {(f"{k}_R" if k in of_l else k): v for k, v in of_r.items() if k != key})
    n = rows.count()
    if settings.get("fixed_literals", False):  # combine literals as they are cut once
        return M.Data(rows, tuple(candidate_literals(rows, s, c, n) for s in sides), n=n), tuple(list(s) for s in sides), c
    lits = tuple(candidate_literals(rows, s, c, n) for s in sides)
    return M.Data(rows, lits, n=n, kinds=sides), tuple(list(s) for s in sides), c


def run(spark: SparkSession, task: str, settings: dict) -> list[dict]:
    """Do the task, write the redescriptions to settings['out'] if given, and return them."""
    data, columns, c = load(spark, settings)
    if task == "mine":
        found = M.mine(data, c, settings.get("only_pairs", False))
    elif task == "folds":
        found = K.run_folds(data.rows, settings.get("k", 5), lambda rows: [x["queries"] for x in M.mine(M.Data(rows, data.literals, kinds=data.kinds), c)], settings.get("seed", 0))
        found = M.scored(data, c, [x["queries"] for x in found])
    else:
        given = M.scored(data, c, [x["queries"] for x in R.read_redescriptions(spark, settings["redescriptions"])])
        found = _given(task, given, data, columns, c, settings)
    if settings.get("out"):
        R.write_redescriptions(spark, found, settings["out"])
    data.rows.unpersist()
    return found


def _given(task: str, given: Sequence[dict], data: M.Data, columns: tuple[list[str], list[str]], c: M.Constraints, settings: dict) -> list[dict]:
    if task == "filter":
        return M.select_final(data, c, list(given))
    if task == "normalize":
        return M.scored(data, c, [M.normalized(x)["queries"] for x in given])
    if task == "expand":
        return M.select_final(data, c, [y for x in given for y in M.expand(data, c, x)])
    if task == "improve":
        better = [X.prune(data.rows, X.improve(data.rows, X.fill_anonymous(data.rows, x["queries"], data.literals, c.parts_type), data.literals, c.parts_type)) for x in given]
        return M.select_final(data, c, M.scored(data, c, list(dict.fromkeys(better))))
    if task == "rnd":
        return [x | {"pval": K.randomised_pvalue(data.rows, x["queries"], columns[1], settings.get("copies", 20), settings.get("seed", 0))} for x in given]
    raise ValueError(f"no such task: {task}")


def main(args: Sequence[str]) -> None:
    task, path = args
    spark = SparkSession.builder.appName("duolith").getOrCreate()
    for x in run(spark, task, read_settings(spark, path)):
        print(f"{x['acc']:.3f}\t{x['pval']:.3g}\t{x['left']}\t{x['right']}")
    spark.stop()
