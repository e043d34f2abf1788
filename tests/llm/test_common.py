import random

import pytest
from pyspark.sql import functions as F

from duolith.functions import settle
from duolith.llm.common import BATCH_BYTES, map_texts, running
from duolith.llm.components import components


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(9), rng.choice([1, 5, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, k int, v long").repartition(7)
    got = {r.i: (r.n, r.s) for r in running(df, [F.col("k"), -F.col("i")], {"n": F.lit(1), "s": F.col("v")}).collect()}
    n = s = 0
    for i, _, v in sorted(rows, key=lambda r: (r[1], -r[0])):
        n, s = n + 1, s + (v or 0)
        assert got[i] == (n, s)
    assert running(df.limit(0), [F.col("k")], {"n": F.lit(1)}).count() == 0


def test_workers_get_small_batches(spark):
    sizes = []

    def fn(texts):
        return {"n": [len(texts)] * len(texts)}

    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("i"), F.repeat(F.lit("x"), 20_000).alias("text"))
    out = map_texts(df, fn, "n long", keep="i long")
    sizes = [r.n for r in out.select("n").distinct().collect()]
    assert max(sizes) <= BATCH_BYTES // 20_000 + 1
    assert out.count() == 3000


def test_long_chains_and_many_components(spark):
    rng = random.Random(2)
    order = list(range(300))
    rng.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(299) if i % 100 != 99]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges * 2, "a long, b long"), "a", "b").collect()}
    for part in (order[:100], order[100:200], order[200:]):
        assert {found[x] for x in part} == {min(part)}


class Cluster:
    """A session on a cluster that names no folder."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            return None

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return default


def test_no_folder_of_one_machine_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        settle.shared_folder(Cluster)
