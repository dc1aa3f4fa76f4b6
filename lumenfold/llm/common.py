"""Shared plumbing of the operators: reading, cutting lineage, held-out folds."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.graph import connected_components, cut, ensure_checkpoint_dir  # noqa: F401

#: The contract's word pattern, for native plans.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Lets Arrow batches of long texts hold at most ``most`` bytes (the session's setting if that is less)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "67108864").lower().rstrip("b")
    held = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1] in "kmg" else int(now)
    if held > most or held <= 0:
        spark.conf.set(key, str(most))


def vocabulary_path(vocabulary: str) -> str:
    """A tokenizer file's place on this machine: a path as it is, or the name of one of the public files."""
    if os.path.isabs(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written in decimal, modulo ``modulus``; a null id falls in fold 0 (held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words, without making them: removing all but one byte of each word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_sample(df: DataFrame, key: str, most: int, salt: int = 1) -> DataFrame:
    """At most ``most`` rows of ``df``, picked by a hash of ``key``; all of them where there are no more.

    Rows are filtered where they are; unlike an ordered limit, no task sends ``most`` rows of its own.
    """
    n = df.count()
    if n <= most:
        return df
    share = int(0.9 * most / n * (1 << 40))
    return df.filter(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 40)) < share).limit(most)


#: Rows of a small side that may be broadcast; with more, it is joined with ``SALTS`` salts.
SIDE, SALTS = 200_000, 32


def spread(rows: DataFrame, side: DataFrame, key: str | list[str], by: str) -> DataFrame:
    """Left join of ``side``, one row a ``key`` (a column or several), to ``rows`` of which a key may have any number.

    ``side`` is counted: up to ``SIDE`` rows are broadcast; more are copied to ``SALTS`` salts, which rows take by a hash of ``by``.
    """
    side = cut(side)
    if side.count() <= SIDE:
        return rows.join(F.broadcast(side), key, "left")
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit(3)), F.lit(SALTS)).cast("int")).join(salted, [*([key] if isinstance(key, str) else key), "_salt"], "left").drop("_salt")


def threshold(df: DataFrame, column: str, most: int) -> int:
    """The smallest of a grid of values (64 to a doubling) that at most ``most`` rows reach, from two passes of sums."""

    def reach(values: list[int]) -> list[int]:
        row = df.agg(*[F.coalesce(F.sum(F.when(F.col(column) >= v, 1)), F.lit(0)).alias(f"n{i}") for i, v in enumerate(values)]).first()
        return list(row)

    powers = [1 << k for k in range(63)]
    k = next(i for i, n in enumerate([*reach(powers), 0]) if n <= most)
    if k == 0:
        return 1
    steps = sorted({(1 << k - 1) + max(1, (1 << k - 1) * i // 64) for i in range(65)})
    return next((v for v, n in zip(steps, reach(steps)) if n <= most), 1 << k)
