"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing of sources, BPE encoding.

Each stage takes the rows that its predecessor kept and returns the columns of `documents`; the last one returns what the
encoding of each row comes to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from duolith.functions.settle import shared_folder
from duolith.llm import bpe, exact_dedup, ngram_join, quality_rules, source_mix
from duolith.llm.common import read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, without the lines that many documents of their source share.

    Null and empty texts fail the rules and go; a null source is one of its own; rows that repeat stay or go together; very long
    texts are judged whole. Other columns stay as they are. An empty table gives no rows.
    """
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts: that of the smallest doc_id, null last.

    Null and empty texts are equal to each other; of rows that repeat id and text one stays. An empty table gives no rows.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each class of near copies: five-word shingles, similarity 0.8 or more; that of the smallest doc_id, null last.

    Texts without words, null ones too, are like no other and stay; of rows that repeat id and text one stays. An empty table gives
    no rows.
    """
    return ngram_join.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents left out, taken once or twice, and some in part.

    Texts without words, null ones too, have nothing to take and go; rows that repeat are documents of their own; a null source is
    one, the last. Ties are broken by the hash of the id, then id, size and place. An empty table gives no rows.
    """
    return source_mix.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix, repeated ones too. A null text has no tokens, texts of any length
    are encoded whole, and an empty table gives no rows."""
    return bpe.digests(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("source_mix", mixed), ("bpe", encoded)]
#: SQL can't express the tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written to the shared checkpoint folder and read again. A result goes when the next one
    is written; the last one stays, since the rows returned are read from it."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
