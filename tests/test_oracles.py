"""Every registered query with SQL agrees with it at the smallest scale; the others run."""

import math
from decimal import Decimal

import duckdb
import pytest

from easel.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "0" if abs(v) < 1e-9 else f"{v:.10g}"
    if isinstance(v, (list, tuple)):
        return str([x + 0.0 if isinstance(x, float) else x for x in v])  # arrays are compared to the last digit
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([norm(r[c]) for c in cols] for r in df.collect()), key=str)
    if (sql := registry.oracles().get(name)) is None:
        assert got and len(set(df.columns)) == len(cols)
        return
    rel = duck.sql(sql)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert cols == sorted(rel.columns)
    assert got == sorted(([norm(r[i]) for i in at] for r in rel.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 500 + 167  # every third image is there twice
    assert set(e.oracle_sql()) <= set(e.queries())
