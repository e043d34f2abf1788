"""Each registered query of the library runs, and gives the rows of its SQL."""

import importlib.util
import math
import os
from datetime import datetime

import pytest

import __spark_entry__
from duolith.plans import catalogue

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v.isoformat() if isinstance(v, datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    if name not in catalogue.oracle_sql():
        assert rows
        return
    out = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(out.columns) == sorted(df.columns)
    at = [out.columns.index(c) for c in sorted(out.columns)]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    has_llm = importlib.util.find_spec("duolith.llm") is not None
    assert any(n.startswith("op1_") for n in __spark_entry__.queries()) == has_llm
