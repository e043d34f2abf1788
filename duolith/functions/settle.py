"""Results that are written once, so that what is counted on one use is still so on the next, also after an executor was lost."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. Only a session on one machine may do without: it gets a temporary one.

    On a cluster a folder of the driver's machine would be of no use to the executors, so there it is an error to name none.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="duolith-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df from files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
