"""Data extensions: named functions that add tables to the aligned rows, for metrics that need more than the two sides.

An extension makes its tables once from the rows and its parameters, and gives metrics of a redescription from them. `geo` makes
the neighbour graph of places; others are registered by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expressions import Node, to_column
from ..functions.settle import settled
from .graph import cohesion, connected_components, grid_edges

Maker = Callable[..., dict[str, DataFrame]]
Metric = Callable[[dict[str, DataFrame], DataFrame], DataFrame]


@dataclass
class Extension:
    """make: the tables of the extension from the rows and parameters. metrics: each from the tables and the rows (rid) of a support."""

    make: Maker
    metrics: dict[str, Metric] = field(default_factory=dict)


POOL: dict[str, Extension] = {}


def register(name: str, make: Maker, **metrics: Metric) -> None:
    if name in POOL:
        raise ValueError(f"there is an extension {name} already")
    POOL[name] = Extension(make, metrics)


@dataclass
class Extended:
    """Rows with the tables of the extensions that were made for them."""

    rows: DataFrame
    rid: str = "rid"
    tables: dict[str, dict[str, DataFrame]] = field(default_factory=dict)

    def add(self, name: str, **parameters) -> "Extended":
        self.tables[name] = {k: settled(v) for k, v in POOL[name].make(self.rows, rid=self.rid, **parameters).items()}
        return self

    def metric(self, name: str, which: str, queries: tuple[Node, Node]) -> DataFrame:
        """A metric of an extension on the rows where both queries hold."""
        inside = self.rows.where(to_column(queries[0]) & to_column(queries[1])).select(F.col(self.rid).alias("rid"))
        return POOL[name].metrics[which](self.tables[name], inside)


def _places(rows: DataFrame, rid: str = "rid", x: str = "x", y: str = "y", reach: float = 1.0) -> dict[str, DataFrame]:
    points = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(rid).alias("rid"), F.col(x).alias("x"), F.col(y).alias("y"))
    return {"edges": grid_edges(points, reach)}


def _pieces(tables: dict[str, DataFrame], inside: DataFrame) -> DataFrame:
    """n_pieces, n_largest: the connected pieces of a support with two places or more, and the size of the largest."""
    s = inside.select(F.col("rid").alias("a"))
    kept = tables["edges"].join(s, "a", "left_semi").join(s.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    sizes = connected_components(kept).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_pieces"), F.coalesce(F.max("n"), F.lit(0)).alias("n_largest"))


register("geo", _places, cohesion=lambda tables, inside: cohesion(tables["edges"], inside), pieces=_pieces)
