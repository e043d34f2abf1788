"""Reading and writing of tables: CSV with typed headers, sparse triples and pairs, coordinates, metadata rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import BOOLEAN, CATEGORICAL, NUMERICAL, kinds, typed

# Names that mark special columns and rows of the format. Fixed values.
ID_NAMES = ("id", "ids", "identifier", "identifiers", "row_name", "row_names")
CID_NAMES, VALUE_NAMES = ("cid", "variable", "variables", "cids"), ("value", "values")
LATITUDES, LONGITUDES = ("lat", "latitude", "latitudes"), ("long", "longitude", "longitudes")
CONDITIONS, ENABLED, GROUPS = ("cond_time", "cond_var", "cond_col"), ("enabled_row", "enabled_rows", "enabled_col", "enabled_cols"), ("groups_col", "groups_cols")
LETTERS = {"B": BOOLEAN, "C": CATEGORICAL, "N": NUMERICAL}
NO_PLACE = -361.0
DELIMITERS = (",", ";", "\t", "|")


def sniff(line: str) -> str:
    """The delimiter that the first line has most often."""
    return max(DELIMITERS, key=line.count)


def unique_names(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen[n] = seen.get(n, 0) + 1
        out.append(n if k == 1 else f"{n} (duplicate#{k})")
    return out


def is_number(text: str) -> bool:
    return re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", text) is not None


def read_csv(spark: SparkSession, path: str, *, delimiter: str | None = None, na: str = "nan") -> tuple[DataFrame, dict[str, int]]:
    """The table with names from its header, and the kinds that the header forces.

    Rows that begin with # are skipped. A first row with numbers is data, and the columns are v0, v1, ... A last header cell
    type=B, C or N forces all columns, [1]name, [2]name, [3]name one column. Repeated names get (duplicate#k).
    """
    # of several files each has the header; the first line is that of the first file by name, and of its first block
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", at.alias("at")).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    first = lines.agg(F.min_by("value", "at").alias("value")).where("value IS NOT NULL").collect()
    if not first:
        raise ValueError(f"no rows in {path}")
    delimiter = delimiter or sniff(first[0]["value"])
    head = [x.strip().strip('"') for x in first[0]["value"].split(delimiter)]
    forced: dict[str, int] = {}
    every = None
    if m := re.fullmatch(r"type=([BCN])", head[-1]):
        every, head = LETTERS[m[1]], head[:-1]
    has_header = not any(map(is_number, head))
    names = head if has_header else [f"v{i}" for i in range(len(head))]
    plain = []
    for n in names:
        m = re.fullmatch(r"\[([123])\](.*)", n)
        plain.append(m[2] if m else n)
    plain = unique_names(plain)
    for n, original in zip(plain, names):
        if m := re.fullmatch(r"\[([123])\].*", original):
            forced[n] = int(m[1])
        elif every and n.lower() not in ID_NAMES + ENABLED:
            forced[n] = every
    schema = ", ".join(f"`{n}` string" for n in plain)
    df = spark.read.csv(path, schema=schema, sep=delimiter, comment="#", header=has_header, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.select(*(F.nullif(F.col(f"`{n}`"), F.lit(na)).alias(n) for n in plain)), forced


def is_sparse(df: DataFrame) -> bool:
    return any(c.lower() in CID_NAMES for c in df.columns)


def special(df: DataFrame, names: tuple[str, ...]) -> str | None:
    return next((c for c in df.columns if c.lower() in names), None)


def from_sparse(df: DataFrame, default: float | None = 0.0) -> DataFrame:
    """A wide table from triples (id, cid, value), or from pairs (id, cid), whose columns are Boolean. `default` fills cells without a row
    in numeric columns. The names of the variables are collected: they become columns."""
    rid, cid, value = special(df, ID_NAMES), special(df, CID_NAMES), special(df, VALUE_NAMES)
    names = [r[0] for r in df.select(cid).where(F.col(cid).isNotNull()).distinct().orderBy(cid).collect()]
    if value is None:
        wide = df.withColumn("_v", F.lit(True)).groupBy(rid).pivot(cid, names).agg(F.first("_v"))
        return wide.select(rid, *(F.coalesce(F.col(f"`{n}`"), F.lit(False)).alias(n) for n in names))
    wide = df.groupBy(rid).pivot(cid, names).agg(F.first(value))
    of = kinds(wide.drop(rid))
    fill = lambda n: F.coalesce(F.col(f"`{n}`"), F.lit(str(default))) if of[n] == NUMERICAL and default is not None else F.col(f"`{n}`")
    return wide.select(rid, *(fill(n).alias(n) for n in names))


def to_sparse(df: DataFrame, rid: str, pairs: bool = False) -> DataFrame:
    """Triples (id, cid, value) of the cells that aren't null, or pairs of the true Booleans."""
    names = [c for c in df.columns if c != rid]
    cells = F.array(*(F.struct(F.lit(c).alias("cid"), F.col(f"`{c}`").cast("string").alias("value")) for c in names))
    long = df.select(F.col(rid).alias("id"), F.explode(cells).alias("c")).select("id", "c.cid", "c.value")
    return long.where("value = 'true'").drop("value") if pairs else long.where("value IS NOT NULL")


def take_metadata(df: DataFrame) -> tuple[DataFrame, dict[str, bool], dict[str, str]]:
    """The rows of data, and from the rows named so which columns are enabled, and their groups."""
    rid = special(df, ID_NAMES)
    if rid is None:
        return df, {}, {}
    lower = F.lower(F.col(rid))
    found = {r[rid].lower(): r for r in df.where(lower.isin(*ENABLED, *GROUPS)).collect()}
    enabled, groups = {}, {}
    for name, row in found.items():
        for c in df.columns:
            if c != rid and row[c] is not None:
                if name in GROUPS:
                    groups[c] = row[c]
                else:
                    enabled[c] = str(row[c]).lower() not in ("0", "false", "f")
    return df.where(~lower.isin(*ENABLED, *GROUPS) | F.col(rid).isNull()), enabled, groups


def coordinates(df: DataFrame) -> DataFrame:
    """df with lat and long as arrays of doubles, from text with : between the points of a polygon; a missing place is one of -361."""
    lat, lon = special(df, LATITUDES), special(df, LONGITUDES)
    points = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit(str(NO_PLACE))), ":"), lambda x: F.coalesce(x.try_cast("double"), F.lit(NO_PLACE)))
    return df.select(*(c for c in df.columns if c not in (lat, lon)), points(lat).alias("lat"), points(lon).alias("long"))


def write_coordinates(df: DataFrame, path: str, rid: str = "id") -> None:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ":").alias(c)
    df.select(rid, text("lat"), text("long")).write.csv(path, header=True)


def condition(df: DataFrame, time_format: str | None = None) -> DataFrame:
    """df with its condition column as a number; times become seconds since 1970."""
    c = special(df, CONDITIONS)
    if c is None:
        return df
    as_time = F.unix_timestamp(F.try_to_timestamp(F.col(c), F.lit(time_format)) if time_format else F.try_to_timestamp(F.col(c)))
    return df.withColumn(c, F.coalesce(F.col(c).try_cast("double"), as_time.cast("double")))


def import_pair(spark: SparkSession, left: str, right: str, **options) -> tuple[DataFrame, DataFrame, dict[str, int], dict[str, int]]:
    """Both sides, sparse or dense, typed, with the kinds of their columns."""
    out = []
    for path in (left, right):
        df, forced = read_csv(spark, path, **options)
        df, enabled, _ = take_metadata(df)
        df = from_sparse(df) if is_sparse(df) else df
        df = df.select(*(c for c in df.columns if enabled.get(c, True)))
        rid = special(df, ID_NAMES)
        of = kinds(df.drop(rid) if rid else df, forced=forced)
        out.append((typed(df, of), of))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def read_transactions(spark: SparkSession, path: str, **options) -> tuple[DataFrame, dict[str, int]]:
    """One side alone, dense or sparse, typed, with the kinds of its columns; transactions are pairs of an id and an item."""
    df, forced = read_csv(spark, path, **options)
    df = from_sparse(df) if is_sparse(df) else df
    rid = special(df, ID_NAMES)
    of = kinds(df.drop(rid) if rid else df, forced=forced)
    return typed(df, of), of


def write_csv(df: DataFrame, path: str, rid: str, density: float = 0.25) -> str:
    """Write dense, or as triples or pairs where a smaller share of the cells is filled; gives the form."""
    names = [c for c in df.columns if c != rid]
    flags = [c for c, t in df.dtypes if c != rid and t == "boolean"]
    filled = F.sum(sum((F.coalesce(F.col(f"`{c}`"), F.lit(False)) if c in flags else F.col(f"`{c}`").isNotNull()).cast("long") for c in names))
    row = df.agg(filled.alias("f"), F.count("*").alias("n")).first()
    sparse = row["n"] and row["f"] < density * row["n"] * len(names)
    if not sparse:
        df.write.csv(path, header=True)
        return "dense"
    pairs = len(flags) == len(names)
    to_sparse(df, rid, pairs).write.csv(path, header=True)
    return "pairs" if pairs else "triples"
