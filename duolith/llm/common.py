"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.settle import settled

#: White space of the contracts, as a Java and Python character class. `bytes.split()` splits at the same characters.
SPACES = r"[\x20\x09-\x0D]+"
#: A word of the contracts.
WORDS = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at once, unless one text alone has more.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from those files, so that a lost executor costs no more than a read."""
    return settled(df)


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about CHUNK_BYTES of the column each, so that memory follows the bytes and not the row count."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > CHUNK_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


#: Bytes of an Arrow batch that is sent to a worker or back, unless a row alone has more.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends Arrow batches of BATCH_BYTES from now on: by default they hold up to 10,000 rows and 64 MB, several times
    in each task's memory outside of the heap. A limit that the session was started with stays."""
    name, session = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if not session.sparkContext.getConf().contains(name):
        session.conf.set(name, str(BATCH_BYTES))
    return df


def release() -> None:
    """Give free memory back at the end of a task: Python workers live on, and beside them the next stage needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, fn: Callable[[list], dict[str, list]], schema: str, *, text: str = "text", args: tuple[str, ...] = (), keep: str = "", raw: bool = False, done: Callable[[], None] | None = None) -> DataFrame:
    """Apply fn to lists of whole texts, and of the values of the columns in args, on the executors; a null text is empty.

    df holds the text column and the columns to keep (as DDL in `keep`); fn gives the further columns that `schema` names.
    raw: fn gets UTF-8 bytes instead of str. done: called at the end of each task; Python workers live on and keep what modules hold.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added, kept = StructType.fromDDL(schema), StructType.fromDDL(keep) if keep else StructType()
    out = StructType(kept.fields + added.fields)
    arrow, names, kept_names = to_arrow_schema(out), added.names, kept.names
    empty = b"" if raw else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            column = part.column(text)
            texts = [empty if x is None else x for x in (column.cast(pa.binary()) if raw else column).to_pylist()]
            made = fn(texts, *(part.column(a).to_pylist() for a in args))
            columns = [part.column(n) for n in kept_names] + [made[n] for n in names]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        if done:
            done()
        release()

    return small_batches(df).mapInArrow(run, out)


def ddl(df: DataFrame, *names: str) -> str:
    """The DDL of some columns of df, for `keep`."""
    types = dict(df.dtypes)
    return ", ".join(f"`{n}` {types[n]}" for n in names)


def whole(column: str) -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns under names that clash with no others, and those names by the old ones."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def one_of_each(found: DataFrame, kept: DataFrame, keys: list[str], twins: str, columns: list[str]) -> DataFrame:
    """The columns of found, rows joined with kept, whose column `twins` tells how many rows have a row's keys: of rows with equal keys
    one stays.

    Only where kept, which is written already, has such keys a window over their rows is planned, so that other texts aren't
    shuffled for it.
    """
    if not kept.where(F.col(twins) > 1).head(1):
        return found.select(*columns)
    order = Window.partitionBy(*keys).orderBy(F.lit(0))
    rest = found.where(F.col(twins) > 1).withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    return found.where(F.col(twins) == 1).select(*columns).unionByName(rest.select(*columns))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in sums, the sum of its column over the rows up to and including a row in the order, over all rows.

    The rows are dealt to tasks by ranges of the order; each task adds up its own rows, and the totals of the ranges before it, one
    row for each task, are added. No task has all rows. The order must be total, else rows that tie may get each other's sums.
    """
    keys, names = [f"_o{i}" for i in range(len(order))], list(sums)
    keyed = df.select("*", *(o.alias(k) for o, k in zip(order, keys)), *(F.coalesce(c, F.lit(0)).alias(f"_v{i}") for i, c in enumerate(sums.values())))
    placed = cut(keyed.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    parts = placed.groupBy("_range").agg(*(F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(names))))  # as many rows as tasks
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_range", *(F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(names))))
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *(F.sum(f"_v{i}").over(inside).alias(f"_s{i}") for i in range(len(names))))
    full = local.join(F.broadcast(offsets), "_range")
    return full.select(*df.columns, *((F.col(f"_s{i}") + F.col(f"_b{i}")).alias(n) for i, n in enumerate(names)))
