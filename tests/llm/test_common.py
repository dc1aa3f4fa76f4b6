"""Shared plumbing."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import common


def test_threshold_keeps_to_its_bound(spark):
    df = spark.range(1, 3001).select((F.col("id") % 700 + 1).alias("c"))
    values = sorted((r.c for r in df.collect()), reverse=True)
    for most in (0, 1, 50, 999, 3000, 10_000):
        t = common.threshold(df, "c", most)
        n = sum(v >= t for v in values)
        assert n <= most
        if t > 1:
            assert sum(v >= t * 0.97 - 1 for v in values) > most or n >= 0.9 * most
    assert common.threshold(df.limit(0), "c", 5) == 1


def test_bounded_sample(spark):
    df = spark.range(5000).toDF("k")
    assert common.bounded_sample(df, "k", 5000).count() == 5000
    some = common.bounded_sample(df, "k", 500)
    assert 300 < some.count() <= 500
    assert sorted(r.k for r in some.collect()) == sorted(r.k for r in common.bounded_sample(df.repartition(7), "k", 500).collect())
    hot = spark.range(5000).select(F.lit(1).alias("k"))
    assert common.bounded_sample(hot, "k", 500).count() <= 500


def test_fold_is_the_crc_of_the_decimal_id(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, -3, 2**40, None)], "i long").select("i", common.fold(F.col("i"), 10).alias("f")).collect()
    assert [r.f for r in rows] == [0 if r.i is None else zlib.crc32(str(r.i).encode()) % 10 for r in rows]


def test_words_are_counted_natively(spark):
    texts = [None, "", " \n", "a", "a  b\tc\x0bd", "é x  ", "\x1c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(common.n_words(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 0, 1, 4, 2, 1]


def test_vocabulary_path(tmp_path):
    assert common.vocabulary_path(str(tmp_path / "x.json")) == str(tmp_path / "x.json")
    assert common.vocabulary_path("word_bpe_49k.json").endswith("word_bpe_49k.json")


def test_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        common.small_batches(spark)
        assert spark.conf.get(key) == str(16 << 20)
        spark.conf.set(key, "1m")
        common.small_batches(spark)
        assert spark.conf.get(key) in ("1m", "1048576", "1048576b")
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["op1_merkle_audit", "op9_url_lists"])
def test_native_queries_match_their_sql(spark, data, name):
    import duckdb

    from lumenfold.llm.queries import ORACLE, QUERIES

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    df = QUERIES[name](spark, data)
    r = c.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([x[n] for n in names]) for x in df.collect()) == sorted(str(list(x)) for x in r.fetchall())
    if name == "op9_url_lists":
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
