"""Locality-sensitive hashing of supports: MinHash bands find literals that hold for nearly the same rows.

A signature is the least of (a * row + b) mod p over the rows of a support, for
several a and b in each band. The signature of a run of buckets is the
element-wise least of its buckets' signatures, so rows are hashed once each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..expressions import Node, to_column


def next_prime(n: int) -> int:
    """The first prime above n."""
    n = max(n, 1) + 1
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def band_rows(bands: int, threshold: float) -> int:
    """Rows of a band so that the curve of chances rises at the threshold."""
    return max(1, math.floor(math.log(1 / bands) / math.log(threshold))) if 0 < threshold < 1 and bands > 1 else 1


def coefficients(n: int, bands: int, rows: int, seed: int = 0) -> list[list[tuple[int, int]]]:
    """a from 1 on, since a factor of 0 would give all rows one hash, and b from 0, both below n."""
    rng = np.random.default_rng(seed)
    return [[(int(a), int(b)) for a, b in rng.integers((1, 0), max(n, 2), (rows, 2))] for _ in range(bands)]


def out_factor(score: float, rows: int, min_out: int) -> float:
    """How many times min_out a literal of a pair with the score leaves uncovered at least."""
    return (score * min_out - score * rows + rows + min_out) / (2 * min_out) if min_out else 1.0


def hashes(rid: Column, coeffs: Sequence[Sequence[tuple[int, int]]], p: int) -> list[Column]:
    return [((F.lit(a) * rid + F.lit(b)) % F.lit(p)).alias(f"h{i}_{j}") for i, band in enumerate(coeffs) for j, (a, b) in enumerate(band)]


def signatures(supports: DataFrame, coeffs: Sequence[Sequence[tuple[int, int]]], p: int, key: Sequence[str] = ("side", "lit"), rid: str = "rid") -> DataFrame:
    """The key, n (the size of the support) and sig, an array of arrays, band by band. supports: the key and rid, a row for each row of each.

    One aggregate with partial sums on the map side; an empty support has no rows and so no signature.
    """
    hashed = supports.select(*key, *hashes(F.col(rid), coeffs, p))
    names = [[f"h{i}_{j}" for j in range(len(band))] for i, band in enumerate(coeffs)]
    mins = hashed.groupBy(*key).agg(F.count("*").alias("n"), *(F.min(n).alias(n) for band in names for n in band))
    return mins.select(*key, "n", F.array(*(F.array(*band) for band in names)).alias("sig"))


def interval_signatures(buckets: DataFrame, bands: int, rows: int, min_in: int, most: float) -> DataFrame:
    """side, cid, first, last, n, sig of the runs of buckets with between min_in and most rows; of runs from one bucket on with an equal band
    the longest counts in it, which the join over bands sees to. buckets: side, cid, bucket, n, sig, few for each column."""
    order = Window.partitionBy("side", "cid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = buckets.withColumn("upto", F.sum("n").over(order))
    a = sums.select("side", "cid", F.col("bucket").alias("first"), (F.col("upto") - F.col("n")).alias("before"))
    b = sums.select("side", "cid", F.col("bucket").alias("last"), F.col("upto"))
    runs = a.join(b, ["side", "cid"]).where(F.col("first") <= F.col("last")).withColumn("n", F.col("upto") - F.col("before")).where((F.col("n") >= min_in) & (F.col("n") <= most))
    covered = runs.join(sums.select("side", "cid", "bucket", "sig"), ["side", "cid"]).where(F.col("bucket").between(F.col("first"), F.col("last")))
    least = [F.min(F.get(F.get("sig", F.lit(i)), F.lit(j))).alias(f"h{i}_{j}") for i in range(bands) for j in range(rows)]
    made = covered.groupBy("side", "cid", "first", "last", "n").agg(*least)
    return made.select("side", "cid", "first", "last", "n", F.array(*(F.array(*(f"h{i}_{j}" for j in range(rows))) for i in range(bands))).alias("sig"))


def longest_runs(banded: DataFrame) -> DataFrame:
    """Of runs (side, cid, first, last, band, sig) that start at one bucket and have an equal signature in a band, the longest."""
    return banded.groupBy("side", "cid", "first", "band", "sig").agg(F.max("last").alias("last"))


def in_bands(signed: DataFrame, *keep: str) -> DataFrame:
    """A row for each band: the columns to keep, band, sig."""
    return signed.select(*keep, F.posexplode("sig").alias("band", "sig"))


def candidates(signed: DataFrame, lit: str = "lit") -> DataFrame:
    """left, right, n_bands: literals of the two sides that agree in a band, and in how many; an equi-join on the band and its signature."""
    rows = in_bands(signed, "side", lit)
    left = rows.where("side = 0").select(F.col(lit).alias("left"), "band", "sig")
    right = rows.where("side = 1").select(F.col(lit).alias("right"), "band", "sig")
    return left.join(right, ["band", "sig"]).groupBy("left", "right").agg(F.count("*").alias("n_bands"))


def without_contained(pairs: DataFrame) -> DataFrame:
    """Pairs of intervals (left, l_first, l_last, right, r_first, r_last) that aren't inside another one of their columns on both sides."""
    a, b = pairs.alias("a"), pairs.alias("b")
    inside = (F.col("a.left") == F.col("b.left")) & (F.col("a.right") == F.col("b.right"))
    for s in ("l", "r"):
        inside &= (F.col(f"a.{s}_first") >= F.col(f"b.{s}_first")) & (F.col(f"a.{s}_last") <= F.col(f"b.{s}_last"))
    size = lambda t: sum((F.col(f"{t}.{s}_last") - F.col(f"{t}.{s}_first") for s in ("l", "r")), F.lit(0))
    return a.join(b, inside & (size("a") < size("b")), "left_anti")


def extension_targets(df: DataFrame, left: Node, right: Node, rid: str = "rid") -> DataFrame:
    """target, rid: where a literal to be joined by and should hold (both queries do), and by or (one of them does)."""
    l, r = to_column(left), to_column(right)
    holds = F.array_compact(F.array(F.when(l & r, "and"), F.when(l | r, "or")))
    return df.select(rid, F.explode(holds).alias("target")).select("target", rid)


def extensions(df: DataFrame, left: Node, right: Node, signed: DataFrame, coeffs: Sequence[Sequence[tuple[int, int]]], p: int, rid: str = "rid") -> DataFrame:
    """target, side, lit, n_bands: the literals whose support agrees with a target's in a band. An empty target gives none."""
    probes = in_bands(signatures(extension_targets(df, left, right, rid), coeffs, p, ("target",), rid), "target")
    return probes.join(in_bands(signed, "side", "lit"), ["band", "sig"]).groupBy("target", "side", "lit").agg(F.count("*").alias("n_bands"))


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of the wanted pairs (left, right) that are found."""
    n = wanted.select("left", "right").distinct()
    total = n.count()
    return n.join(found.select("left", "right").distinct(), ["left", "right"], "left_semi").count() / total if total else 1.0
