"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries find the digests that may be frequent. Their exact
sizes and first rows are then counted, and these few verified winners are
broadcast, so that the rows of large groups are settled where they were read.
Only the digests of the other rows are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, aside, cut, one_of_each, read, whole

#: A digest is frequent if it holds at least this share of the rows.
SHARE = 1 / 4096
#: Counters of a Misra-Gries summary; at most 1 / (SHARE - 1 / COUNTERS) digests can be candidates, so a broadcast has 8192 rows at most.
COUNTERS = 8192


def misra_gries(counts: Counter, more: Counter, counters: int) -> Counter:
    """Merge two summaries: add up, then lower all by the largest count that doesn't fit. A count is too low by n / (counters + 1) at most."""
    counts.update(more)
    if len(counts) > counters:
        less = sorted(counts.values(), reverse=True)[counters]
        counts = Counter({k: n - less for k, n in counts.items() if n > less})
    return counts


def frequent(keyed: DataFrame, key: str, rows: int, share: float = SHARE, counters: int = COUNTERS) -> DataFrame:
    """All values of `key` with at least the share of the rows, and perhaps a few more: at most 1 / (share - 1 / counters) in all."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts = misra_gries(counts, Counter(batch.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    parts = keyed.select(F.col(key).alias("digest")).mapInArrow(summary, "digest binary, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2.0, rows * (share - 1 / counters))).select(F.col("digest").alias(key))


def groups(docs: DataFrame, doc_id: str, text: str, share: float, counters: int, **extra: Column) -> DataFrame:
    """doc_id, digest, row, the extra columns, group_size and first (no_id, doc_id, row) of each row's group of equal texts."""
    digest = F.unhex(F.sha2(F.regexp_replace(whole(text), SPACES, " "), 256))
    keyed = cut(docs.select(F.col(doc_id).alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"), *(c.alias(k) for k, c in extra.items())))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    group = [F.count("*").alias("group_size"), F.min(rank).alias("first")]
    rows = keyed.count()
    candidates = frequent(keyed, "digest", rows, share, counters)
    winners = keyed.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(*group).where(F.col("group_size") >= max(2.0, rows * share))
    winners = cut(winners)  # at most 1 / share rows
    heavy = keyed.join(F.broadcast(winners), "digest")
    of = Window.partitionBy("digest")
    light = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("*", *(g_over for g_over in (F.count("*").over(of).alias("group_size"), F.min(rank).over(of).alias("first"))))
    return heavy.unionByName(light)


def exact_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after each run of white space became one space; null counts as empty. Of equal texts the
    row with the smallest id stays; ids that are null come last, and of rows that repeat an id with an equal text one stays.
    Other columns of docs are ignored, an empty table gives no rows.
    """
    return groups(docs, doc_id, text, share, counters).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, counters: int = COUNTERS) -> DataFrame:
    """docs, with all its columns, without all rows but the first of each group of equal texts.

    What is equal and which row stays is as in exact_dedup, for null, empty and very long texts and repeated rows too: of rows
    that agree in id and text any one stays. An empty table gives no rows; names of other columns can't clash.
    """
    full, names = aside(docs)
    # a row is found again by its id and a hash of its text; how many rows agree in both tells if one of several must be picked
    rows = groups(docs, doc_id, text, share, counters, mark=F.xxhash64(whole(text)))
    same = rows.groupBy("doc_id", "mark").agg(F.bool_or(F.col("first.row") == F.col("row")).alias("kept"), F.count("*").alias("twins"))
    kept = cut(same.where("kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "twins"))
    keyed = full.withColumn("mark", F.xxhash64(whole(names[text])))
    found = keyed.join(kept, (F.col("mark") == F.col("_mark")) & F.col(names[doc_id]).eqNullSafe(F.col("_id")))
    return one_of_each(found, kept, ["_mark", "_id"], "twins", list(names.values())).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
