"""Nearest neighbours by multi-index hashing.

Codes: vectors are centred and turned by ``ROTATIONS`` learned rotations (iterative quantisation, fitted
on a bounded sample); signs are bits. A code is split into m 16-bit substrings, each indexed by its value.
If two codes differ in at most r = s * m + a bits (a < m), then one of the first a + 1 substrings differs in
at most s of its own, or one of the others in at most s - 1. Visiting all values that near a query's
substrings retrieves every code within radius r. Retrieved codes are filtered by their whole Hamming
distance and reranked on the original floats.

The radius is the one at which sample queries reach ``recall`` among the sample; true neighbours in the
whole table are nearer than those in the sample, so there it can only be higher. The sample is of distinct
vectors, and both a random draw of queries and one spread over the codes must reach the recall: else groups
of near copies would set the radius, too small for all other queries. A query that finds fewer than k in a
shard widens its radius there to the k-th nearest code.

Rows are dealt into shards, each row into one. A task builds a shard's tables once and streams all queries
through them; only k rows a query leave it. So a row moves once, and a query once a shard.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .multi_index import doubles, usable
from .words import tidy

SAMPLE, DRAWN, ROTATIONS, ROUNDS = 10_000, 500, 2, 15
#: Rows of a shard: a 64th of all, but no less and no more than this.
SHARD_LEAST, SHARD = 16_384, 131_072
SUB = 16
#: All differences of a substring, by their number of bits, and how many have at most so many bits.
_MASKS = np.argsort(np.bitwise_count(np.arange(1 << SUB, dtype=np.uint16)), kind="stable").astype(np.uint16)
_UPTO = np.cumsum(np.bincount(np.bitwise_count(_MASKS), minlength=SUB + 1))


class Codes:
    """Rotations that turn vectors into packed 16-bit substrings."""

    def __init__(self, centre: np.ndarray, turns: list[np.ndarray], radius: int):
        self.centre, self.turns, self.radius = centre, turns, radius

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bits = np.concatenate([(x - self.centre) @ t > 0 for t in self.turns], axis=1)
        spare = -bits.shape[1] % SUB
        bits = np.pad(bits, ((0, 0), (0, spare)))
        return np.packbits(bits, axis=1).view(np.uint16).reshape(len(x), -1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def spread(code: np.ndarray, most: int, gap: int) -> list[int]:
    """Rows picked farthest first, at most ``most``, until every other one is within ``gap`` bits of a pick."""
    picks, far = [0], hamming(code, code[0])
    while len(picks) < most and far.max() > gap:
        picks.append(int(far.argmax()))
        far = np.minimum(far, hamming(code, code[picks[-1]]))
    return picks


def fit(x: np.ndarray, k: int, recall: float, seed: int = 7) -> Codes:
    """Rotations and radius from a bounded sample of vectors."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    centre = x.mean(axis=0)
    z = x - centre
    turns = []
    for _ in range(ROTATIONS):
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(z.T @ np.where(z @ turn > 0, 1.0, -1.0))
            turn = u @ v
        turns.append(turn)
    codes = Codes(centre, turns, dim * ROTATIONS)
    n = len(x)
    if n > k + 1:
        code = codes(x)
        codes.radius = 0
        for drawn in (rng.choice(n, min(DRAWN, n), replace=False), spread(code, DRAWN, dim * ROTATIONS // 8)):
            reach = []
            for i in drawn:
                d = ((x - x[i]) ** 2).sum(axis=1)
                d[i] = np.inf
                near = np.argpartition(d, k)[:k]
                reach.append(hamming(code[near], code[i]))
            codes.radius = max(codes.radius, int(np.quantile(np.concatenate(reach), recall, method="higher")))
    return codes


class Shard:
    """The substring tables of one shard. ``rows`` tells its rows apart, ``ids`` need not."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes, rows: np.ndarray | None = None):
        self.ids, self.x, self.code, self.radius = ids, x, codes(x), codes.radius
        self.rows = ids if rows is None else rows
        self.tables = []
        for j in range(self.code.shape[1]):
            size = np.bincount(self.code[:, j], minlength=1 << SUB)
            self.tables.append((size, np.cumsum(size) - size, np.argsort(self.code[:, j], kind="stable")))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within ``radius``, by the pigeonhole over substrings."""
        most, spare = divmod(radius, len(self.tables))
        hit = np.zeros(len(self.ids), bool)
        for j, (sizes, begin, order) in enumerate(self.tables):
            near = min(most if j <= spare else most - 1, SUB)
            if near < 0:
                continue
            value = (_MASKS[: _UPTO[near]] ^ code[j]).astype(np.int64)
            size = sizes[value]
            end = np.cumsum(size)
            hit[order[np.repeat(begin[value] - end + size, size) + np.arange(end[-1])]] = True
        rows = np.flatnonzero(hit)
        return rows[hamming(self.code[rows], code) <= radius]

    def search(self, own: int, q: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest rows retrieved, but for the row ``own``."""
        rows = self.within(code, self.radius)
        rows = rows[self.rows[rows] != own]
        if len(rows) < k:
            others = np.flatnonzero(self.rows != own)
            if len(others) > k:
                d = hamming(self.code[others], code)
                others = others[d <= max(self.radius, int(np.partition(d, k - 1)[k - 1]))]
            rows = others
        score = np.sqrt(((self.x[rows] - q) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[rows], score))[:k]
        return self.ids[rows][best], score[best]


@tidy
def _searched(batches, codes, k: int, dim: int):
    """Rows sorted by (shard, ask): a shard's own rows, held until its queries come, then those as they come."""
    key, held, shard = None, [], None

    def answers(asks):
        out = ([], [], [], [])
        q = doubles([r[1] for r in asks], dim)
        for (own, _, row), v, code in zip(asks, q, codes.value(q)):
            ids, score = shard.search(row, v, code, k)
            for c, x in zip(out, ([row] * len(ids), [own] * len(ids), ids.tolist(), score.tolist())):
                c.extend(x)
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.float64())], ["ask_row", "query_id", "vec_id", "score"])

    for batch in batches:
        c = batch.to_pydict()
        asks: list = []
        for shard_key, ask, *row in zip(c["shard"], c["ask"], c["vec_id"], c["raw"], c["rid"]):
            if shard_key != key:
                if asks and shard:
                    yield answers(asks)
                key, held, shard, asks = shard_key, [], None, []
            if not ask:
                held.append(row)
                continue
            if held:
                shard = Shard(np.array([r[0] for r in held], np.int64), doubles([r[1] for r in held], dim), codes.value, np.array([r[2] for r in held], np.int64))
                held = []
            asks.append(row)
        if asks and shard:
            yield answers(asks)


def distinct_sample(good: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct vectors, picked by a hash of their bytes; a hash a row and the sample are all that moves."""
    n = good.select(F.xxhash64("raw").alias("h")).distinct().count()
    if n > most:
        good = good.filter(F.pmod(F.xxhash64("raw", F.lit(1)), F.lit(1 << 40)) < int(0.9 * most / n * (1 << 40)))
    return good.select("raw").distinct().limit(most)


def nearest(vectors: DataFrame, is_query, k: int = 10, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query row, by Euclidean distance.

    ``is_query`` is a condition on ``id_col``. Null ids, and vectors that are null, empty, zero, of another
    length than most usable ones, or hold null or non-finite components take no part. A row is not its own
    neighbour; other rows of its id are, and every row counts by itself. Each row of a query id that repeats
    asks for itself, so its answers stand there as often. Ties go to the smaller ``vec_id``. Other columns are
    ignored. No queries give no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    every, dim = usable(vectors)
    good = every.filter("key is not null").select("vec_id", "raw", "rid")
    asks = good.filter(is_query(F.col("vec_id")))
    n = good.count()
    picked = sorted(r["raw"] for r in distinct_sample(good, SAMPLE).collect())
    if not picked or not asks.limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = fit(doubles(picked, dim), k, recall)
    shards = -(-n // min(SHARD, max(SHARD_LEAST, n // 64)))
    rows = good.withColumn("shard", F.pmod(F.xxhash64("vec_id", "raw"), F.lit(shards)).cast("int")).withColumn("ask", F.lit(False))
    asks = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("ask", F.lit(True))
    names = ["shard", "ask", "vec_id", "raw", "rid"]
    dealt = rows.select(names).union(asks.select(names)).repartition("shard").sortWithinPartitions("shard", "ask")
    found = dealt.mapInArrow(functools.partial(_searched, codes=spark.sparkContext.broadcast(codes), k=k, dim=dim), "ask_row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("ask_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)
