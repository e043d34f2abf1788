"""Two sides of one set of entities: alignment, column kinds, long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.settle import settled

BOOLEAN, CATEGORICAL, NUMERICAL = 1, 2, 3
#: Order in which a kind is tried for a column of strings.
CASCADE = (BOOLEAN, NUMERICAL, CATEGORICAL)
TRUE_TOKENS, FALSE_TOKENS = ("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n")


class AlignmentError(ValueError):
    pass


def align(left: DataFrame, right: DataFrame, keys: Sequence[str], *, unique: bool = False, check: bool = False) -> DataFrame:
    """Rows of both sides with equal keys, an inner join; columns of the right side that clash get the suffix _R.

    unique: fail where a key repeats. check: fail where no key is on both sides. Both run a job.
    """
    if unique:
        for side, df in (("left", left), ("right", right)):
            if twice := df.groupBy(*keys).count().where("count > 1").head(1):
                raise AlignmentError(f"key {tuple(twice[0])[:-1]} repeats on the {side} side")
    clash = {c for c in right.columns if c in left.columns and c not in keys}
    right = right.select(*(F.col(f"`{c}`").alias(f"{c}_R" if c in clash else c) for c in right.columns))
    out = left.join(right, list(keys))
    if check and not out.head(1):
        raise AlignmentError("no key is on both sides")
    return out


def numbered(df: DataFrame, rid: str = "rid", order: Sequence[str] = ()) -> DataFrame:
    """df with row numbers from 0, in the given order, or in that of its partitions.

    Counts of the partitions, one number each, give the offsets, so that no task sees all rows.
    """
    df = df.orderBy(*order) if order else df
    # a second sort may cut its partitions elsewhere, so the first one is kept
    placed = settled(df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]
    if not starts:
        return placed.drop("_part", "_at").withColumn(rid, F.lit(None).cast("long"))
    offsets = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    # monotonically increasing ids hold the place in the partition in their lower 33 bits
    return placed.withColumn(rid, (F.element_at(offsets, F.col("_part")) + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_part", "_at")


def align_by_position(left: DataFrame, right: DataFrame, rid: str = "rid") -> DataFrame:
    """Row k of the left side with row k of the right side; both must have as many rows."""
    if (n := left.count()) != (m := right.count()):
        raise AlignmentError(f"{n} rows on the left side, {m} on the right side")
    return align(numbered(left, rid), numbered(right, rid), [rid])


def kinds(df: DataFrame, na: str = "nan", forced: dict[str, int] | None = None) -> dict[str, int]:
    """The kind of each column: by its Spark type, or for strings the first of the cascade that all values fit. One pass for all."""
    found: dict[str, int] = {}
    tests: list[Column] = []
    for name, kind in df.dtypes:
        if forced and name in forced:
            found[name] = forced[name]
        elif kind == "boolean":
            found[name] = BOOLEAN
        elif kind != "string":
            found[name] = NUMERICAL
        else:
            v = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(na))
            logical, numeric = F.lower(v).isin(*TRUE_TOKENS, *FALSE_TOKENS), v.try_cast("double").isNotNull()
            tests += [F.bool_and(v.isNull() | t).alias(f"{name}\n{k}") for k, t in ((BOOLEAN, logical), (NUMERICAL, numeric))]
    if tests:
        row = df.agg(*tests).first()
        for name, kind in df.dtypes:
            if name not in found:
                found[name] = next((k for k in CASCADE[:2] if row[f"{name}\n{k}"]), CATEGORICAL)
    return found


def typed(df: DataFrame, of: dict[str, int], na: str = "nan") -> DataFrame:
    """df with its string columns cast to their kinds; the NA token and what doesn't fit becomes null."""

    def cast(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind != "string" or name not in of:
            return c
        v = F.nullif(F.trim(c), F.lit(na))
        if of[name] == NUMERICAL:
            return v.try_cast("double").alias(name)
        if of[name] == BOOLEAN:
            return F.when(F.lower(v).isin(*TRUE_TOKENS), True).when(F.lower(v).isin(*FALSE_TOKENS), False).alias(name)
        return v.alias(name)

    return df.select(*(cast(n, k) for n, k in df.dtypes))


def cells(df: DataFrame, rid: str, side: int, of: dict[str, int]) -> DataFrame:
    """Long form: side, cid, rid, kind and the value in the column of its kind (b, s or n); nulls stay as rows of nulls."""
    names = [c for c in df.columns if c != rid and c in of]
    value = lambda c, k, t: (F.col(f"`{c}`") if of[c] == k else F.lit(None)).cast(t)
    entry = [F.struct(F.lit(c).alias("cid"), F.lit(of[c]).alias("kind"), value(c, 1, "boolean").alias("b"), value(c, 2, "string").alias("s"), value(c, 3, "double").alias("n")) for c in names]
    return df.select(rid, F.explode(F.array(*entry)).alias("cell")).select(F.lit(side).alias("side"), "cell.cid", rid, "cell.kind", "cell.b", "cell.s", "cell.n")


def matrix(df: DataFrame, rid: str, of: dict[str, int], categories: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """rid and a column of doubles for each variable; a categorical one gives a 0/1 column for each of its categories."""
    out = [F.col(rid)]
    for c, k in of.items():
        if k == CATEGORICAL:
            out += [(F.col(f"`{c}`") == v).cast("double").alias(f"{c}={v}") for v in (categories or {}).get(c, ())]
        else:
            out.append(F.col(f"`{c}`").cast("double").alias(c))
    return df.select(*out)


def row_and_column_sums(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the long form: per side and row, and per side and column, how many true Booleans, categories and numbers, and their sum."""
    stats = [F.count_if("b").alias("n_true"), F.count("s").alias("n_categories"), F.count("n").alias("n_numbers"), F.sum("n").alias("total")]
    return long.groupBy("side", "rid").agg(*stats), long.groupBy("side", "cid").agg(*stats)


def recomputed(df: DataFrame, derived: dict[str, str]) -> DataFrame:
    """df with its derived columns computed anew from the other columns, by checked expressions, each from those before it."""
    from ..expressions import checked_expression

    for name, sql in derived.items():
        df = df.withColumn(name, F.expr(checked_expression(sql, set(df.columns))))
    return df


def subset(df: DataFrame, mapping: DataFrame, rid: str = "rid") -> DataFrame:
    """Select or repeat rows: mapping (old, new) gives each old row's new numbers."""
    return df.join(mapping.select(F.col("old").alias(rid), "new"), rid).withColumn(rid, F.col("new")).drop("new")


def weighted(df: DataFrame, inside: Column, in_weight: int, out_weight: int = 1) -> DataFrame:
    """Each row as often as its weight: in_weight where the condition holds, else out_weight."""
    w = F.when(F.coalesce(inside, F.lit(False)), F.lit(in_weight)).otherwise(F.lit(out_weight))
    return df.withColumn("copy", F.explode(F.when(w > 0, F.sequence(F.lit(1), w)).otherwise(F.array().cast("array<int>"))))


def masked(df: DataFrame, columns: str | None = None, rows: str | None = None, rid: str = "rid") -> DataFrame:
    """Enable by mask strings of 0 and 1: the k-th column but rid, and the row of number k."""
    if columns is not None:
        names = [c for c in df.columns if c != rid]
        df = df.select(rid, *(c for c, m in zip(names, columns) if m == "1"))
    if rows is not None:
        df = df.where(F.substring(F.lit(rows), (F.col(rid) + 1).cast("int"), F.lit(1)) == "1")
    return df


def trait_means(incidence: DataFrame, traits: DataFrame, names: Sequence[str], rid: str = "rid") -> DataFrame:
    """rid, the mean of each trait over the variables of the row, and how many there are. incidence: rid, var, present; traits: var and the names.

    A row without variables has means of 0.
    """
    present = incidence.withColumn("var", F.when(F.coalesce("present", F.lit(False)), F.col("var")))
    joined = present.select(rid, "var").join(traits, "var", "left")
    return joined.groupBy(rid).agg(*(F.coalesce(F.avg(t), F.lit(0.0)).alias(f"mean_{t}") for t in names), F.count("var").alias("n_vars"))

