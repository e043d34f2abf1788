"""Part counts of fixed pairs of queries over a stream of aligned rows, kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expressions import Node, to_column
from ..operators.support import part


def streaming_parts(rows: DataFrame, pairs: Sequence[tuple[Node, Node]], *, time: str | None = None, late: str = "10 minutes", window: str | None = None) -> DataFrame:
    """pair, part, n (and the window) of a stream. With a time column, windows are closed by its watermark; without, the counts are of all
    rows so far: the state has a row for each pair and part, however long the stream is."""
    marks = [F.struct(F.lit(i).alias("pair"), part(to_column(l), to_column(r)).alias("part")) for i, (l, r) in enumerate(pairs)]
    if time:
        rows = rows.withWatermark(time, late)
    marked = rows.select(*([time] if time else []), F.explode(F.array(*marks)).alias("m")).select(*([time] if time else []), "m.pair", "m.part")
    keys = [F.window(time, window).alias("window")] if time and window else []
    return marked.groupBy(*keys, "pair", "part").agg(F.count("*").alias("n"))
