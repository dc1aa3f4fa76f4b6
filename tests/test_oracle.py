"""Every query with an oracle gives the oracle's rows on the smallest tables."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from lumenfold.plans.catalogue import ORACLE, QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, Decimal):
        return f"{float(v):.6f}" if v % 1 else str(int(v))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(name, spark, duck, data):
    df = QUERIES[name](spark, data)
    r = duck.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    got = sorted(tuple(plain(x[c]) for c in cols) for x in df.collect())
    want = sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, data):
    """Queries that SQL can't express give rows, and the same ones whatever the partitioning."""
    got = []
    for parts in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = QUERIES[name](spark, data)
        got.append(sorted(tuple(plain(v) for v in x) for x in df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] and got[0] == got[1]


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(ORACLE) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
