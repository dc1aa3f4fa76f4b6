"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves; each half has a codebook fitted on a bounded sample, and the product of
the two is a grid of cells. A vector lives in the cell of its nearest centres. To find its partners it
visits cells in multi-sequence order, nearest first. A cell's distance is that from the vector to the
cell's border: per half, squared distance to the plane between its own centre and the other one, summed
over the halves. It visits every cell nearer than ``reach``, however many those are. ``reach`` is set by
target recall: sample vectors are turned by exactly the threshold angle, and the smallest reach is taken
at which ``recall`` of these hardest pairs meet. Every pair that meets is verified on the whole vectors
in double precision.

Vectors that are equal are one class with a multiplicity. A class travels once to each cell it visits, its
own included. The residents of a crowded cell are cut into blocks and its visitors into slices; residents
meet block by block, and a slice of visitors meets each block. Tasks return link counts by class and the
links that join components, not pairs.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, connected_components, cut, table
from .words import tidy

#: Rows that fit the codebooks; centres of a half, at most; vectors a cell should hold.
SAMPLE, CENTRES, CELL = 20_000, 512, 2048
#: Residents of a block and visitors of a slice of a crowded cell, and pairs compared at once.
BLOCK, SLICE, MEET = 2048, 8192, 1 << 22


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = distances(x, centre).argmin(axis=1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)[None, :], 0)


def border(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centre's cell: to the plane halfway between it and the row's own centre."""
    d = distances(x, centre)
    own = d.argmin(axis=1)
    apart = 2 * np.sqrt(distances(centre, centre))[own]
    gap = d - d[np.arange(len(x)), own][:, None]
    out = np.where(apart > 0, gap / np.where(apart > 0, apart, 1.0), 0.0) ** 2
    out[np.arange(len(x)), own] = -1.0  # its own cell comes first even where another centre is as near
    return out


class MultiIndex:
    """Codebooks of the two halves, and how far to reach."""

    def __init__(self, first: np.ndarray, second: np.ndarray, reach: float):
        self.first, self.second, self.reach = first, second, reach

    def costs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return border(x[:, :half], self.first), border(x[:, half:], self.second)

    def visit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells in multi-sequence order, those of all rows in one array, and where each row's begin; the first of a row is its own."""
        c1, c2 = self.costs(x)
        n1 = np.argsort(c1, axis=1, kind="stable")
        c1 = np.take_along_axis(c1, n1, 1)
        c2_, low = np.maximum(c2, 0.0), np.maximum(c1, 0.0)
        rows, cells, cost, other = [], [], [], []
        for i in range(c1.shape[1]):  # the i-th nearest centre of the first half, with all of the second that are near enough
            some = np.flatnonzero(low[:, i] <= self.reach)
            if not len(some):
                break
            r, j = np.nonzero(low[some, i][:, None] + c2_[some] <= self.reach)
            rows.append(some[r])
            cells.append(n1[some[r], i] * len(self.second) + j)
            cost.append(low[some[r], i] + c2_[some[r], j])
            other.append((c1[some[r], i] >= 0) | (c2[some[r], j] >= 0))
        rows, cells, cost, other = (np.concatenate(v) for v in (rows, cells, cost, other))
        order = np.lexsort((cells, cost, other, rows))
        return cells[order].astype(np.int32), np.searchsorted(rows[order], np.arange(len(x) + 1))


def fit(sample: np.ndarray, rows: int, cosine: float, recall: float, seed: int = 3) -> MultiIndex:
    """An index for ``rows`` vectors from a bounded sample of them."""
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    k = int(min(CENTRES, max(1, math.ceil(math.sqrt(rows / CELL))), len(sample)))
    index = MultiIndex(kmeans(sample[:, :half], k, rng), kmeans(sample[:, half:], k, rng), 0.0)
    x = sample[rng.choice(len(sample), min(5000, len(sample)), replace=False)]
    turn = rng.standard_normal(x.shape)
    turn -= (turn * x).sum(1)[:, None] * x
    turn /= np.maximum(np.linalg.norm(turn, axis=1), 1e-12)[:, None]
    y = cosine * x + math.sqrt(1 - cosine * cosine) * turn

    def needed(a, b):
        """How far each row of ``a`` must reach to visit the cell of the same row of ``b``."""
        (a1, a2), (b1, b2), at = index.costs(a), index.costs(b), np.arange(len(a))
        return np.maximum(a1[at, b1.argmin(1)], 0.0) + np.maximum(a2[at, b2.argmin(1)], 0.0)

    # a pair meets if either one visits the other's cell
    index.reach = float(np.quantile(np.minimum(needed(x, y), needed(y, x)), recall, method="higher"))
    return index


def _floats(column):
    """Usable rows (finite, not zero, no null components) of a list column, each judged by itself: (positions, float64 vectors) by length."""
    first = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # null components are NaN
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(first), 0)
    for n in np.unique(size[size > 0]):
        places = np.flatnonzero(size == n)
        x = flat[first[places][:, None] + np.arange(n)]
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield places[ok], x[ok]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by the largest component so that squares neither vanish nor overflow."""
    x = x / np.maximum(np.abs(x).max(axis=1, initial=0.0), np.finfo(float).tiny)[:, None]
    return x / np.maximum(np.linalg.norm(x, axis=1), np.finfo(float).tiny)[:, None]


@tidy
def _prepared(batches):
    """Every row with its vector as bytes, a digest of them and its length; nulls where it is not usable.

    Single precision where that loses nothing, double otherwise. Equal vectors have equal bytes.
    """
    for batch in batches:
        raw, keys, dims = ([None] * batch.num_rows for _ in range(3))
        for places, x in _floats(batch.column(1)):
            x = x + 0.0  # no negative zeros
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            exact = (short == x).all(axis=1)
            for i, (at, e) in enumerate(zip(places.tolist(), exact)):
                raw[at] = (short if e else x)[i].tobytes()
                keys[at] = hashlib.blake2b(raw[at], digest_size=16).digest()
                dims[at] = x.shape[1]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "raw", "key", "dim"])


def _usual(every: DataFrame) -> int:
    common = every.filter("vec_id is not null and dim is not null").groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    return common["dim"] if common else 0


def _part(dim: int):
    return F.col("vec_id").isNotNull() & (F.col("dim") == dim)


def prepared(vectors: DataFrame) -> DataFrame:
    return vectors.mapInArrow(_prepared, "vec_id long, raw binary, key binary, dim int")


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, raw, key, rid) of all rows of (vec_id, v), ``raw`` and ``key`` null for those that take no part,
    and the length of those that do: the most frequent one among usable vectors with an id, the smallest of
    equally frequent ones. The length is 0 where there are none. ``rid`` numbers the rows, in no order."""
    every = cut(prepared(vectors).withColumn("rid", F.monotonically_increasing_id()))
    dim = _usual(every)
    return every.select("vec_id", F.when(_part(dim), F.col("raw")).alias("raw"), F.when(_part(dim), F.col("key")).alias("key"), "rid"), dim


def doubles(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors back from their bytes, in double precision."""
    if all(len(r) == 4 * dim for r in raw):
        return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), dim).astype(np.float64)
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in raw], np.float64).reshape(len(raw), dim)


@tidy
def _visits(batches, index, dim: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, first = index.value.visit(unit(doubles(batch.column("raw").to_pylist(), dim)))
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(cells, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("times"), batch.column("raw"), lists], ["cls", "times", "raw", "cells"])


def _alike(x: dict, y: dict, here: slice, cosine: float):
    """Pairs at or above the threshold. Single precision decides but for those within its rounding error, which double precision does."""
    near = x["single"][here] @ y["single"].T
    slack = 4 * np.finfo(np.float32).eps * (x["unit"].shape[1] + 4)
    m, g = np.nonzero(near >= cosine - slack)
    keep = near[m, g] >= cosine + slack
    close = np.flatnonzero(~keep)
    for s in range(0, len(close), 65536):
        at = close[s : s + 65536]
        keep[at] = np.einsum("ij,ij->i", x["unit"][here][m[at]], y["unit"][g[at]]) >= cosine
    return m[keep], g[keep]


class _Tally:
    """Link counts of the classes of a task, and the components its links join them in; the links themselves are not kept."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.unique(ids)
        self.total, self.label = np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))

    def add(self, a, times_a, b, times_b):
        a, b = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)
        np.add.at(self.total, a, times_b)
        np.add.at(self.total, b, times_a)
        while True:  # labels are roots here
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while ((up := self.label[self.label]) != self.label).any():
                self.label = up

    def rows(self):
        some = self.total > 0
        return list(zip(self.ids[some].tolist(), self.total[some].tolist(), self.ids[self.label[some]].tolist()))


def _meet(left: dict, right: dict, same: bool, cosine: float, tally: _Tally) -> None:
    """Tallies the links between the classes that live in a cell and those that come to it.

    Rows of ``left`` live in the cell; rows of ``right`` do too or visit it. Two that live in one cell meet there
    alone. Others may meet in either one's cell: they count where the smaller visits, or else where the larger does.
    ``same``: both sides are one block.
    """
    homes, home = np.unique(right["home"], return_inverse=True)
    cells, row = np.concatenate(left["cells"]), np.repeat(np.arange(len(left["cls"])), [len(c) for c in left["cells"]])
    at = np.minimum(np.searchsorted(homes, cells), len(homes) - 1)
    visits = np.zeros((len(left["cls"]), len(homes)), bool)
    visits[row[homes[at] == cells], at[homes[at] == cells]] = True
    step = max(1, MEET // len(right["cls"]))
    for s in range(0, len(left["cls"]), step):
        here = slice(s, s + step)
        m, g = _alike(left, right, here, cosine)
        a, b = left["cls"][here][m], right["cls"][g]
        resident = (a < b) if same else (a != b)
        keep = np.where(right["lives"][g], resident, (b < a) | ~visits[s + m, home[g]])
        tally.add(a[keep], left["times"][here][m][keep], b[keep], right["times"][g][keep])


@tidy
def _linked(batches, cosine: float, dim: int):
    """Rows sorted by (cell, bi, bj): link counts by class and a spanning forest."""
    key, rows = None, []

    def frame(part):
        x = unit(doubles([r[2] for r in part], dim))
        return {
            "cls": np.array([r[0] for r in part], np.int64),
            "times": np.array([r[1] for r in part], np.int64),
            "unit": x,
            "single": x.astype(np.float32),
            "cells": [np.array(r[3], np.int64) for r in part],
            "home": np.array([r[3][0] for r in part], np.int64),
            "lives": np.array([r[3][0] == key[0] for r in part]),
        }

    def done():
        cell, bi, bj = key

        def of(blk, resident):
            return [r for r in rows if r[4] == blk and (r[3][0] == cell) in resident]

        sides = [(of(bi, (True,)), of(bj, (True, False)))]
        if bi != bj:  # and the other block's residents with this one's visitors
            sides.append((of(bj, (True,)), of(bi, (False,))))
        tally = _Tally(np.array([r[0] for r in rows], np.int64))
        for left, right in sides:
            if left and right:
                _meet(frame(left), frame(right), bi == bj, cosine, tally)
        return tally.rows()

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["cls", "n", "root"])

    for batch in batches:
        out = []
        c = batch.to_pydict()
        for *k, cls, times, raw, cells, blk in zip(c["cell"], c["bi"], c["bj"], c["cls"], c["times"], c["raw"], c["cells"], c["blk"]):
            if k != key:
                if rows:
                    out += done()
                key, rows = k, []
            rows.append((cls, times, raw, cells, blk))
        yield batch_of(out)
    if rows:
        yield batch_of(done())


def near_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.999, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Vectors that are null, empty, zero, of another length than most usable ones, or hold null or
    non-finite components link with nothing. Rows that repeat an id are vectors of their own that share
    it. A null id links with nothing and is kept. Equal vectors link whatever the index does. Other
    columns are ignored. No rows give no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    every = cut(prepared(vectors).drop("raw"))  # narrow; the vectors themselves move once to their class
    dim = _usual(every)
    alone = every.filter(~F.coalesce(_part(dim), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    if not dim:
        return alone.select("*", kept)
    good = every.filter(_part(dim))
    classes = cut(prepared(vectors).filter(_part(dim)).groupBy("key").agg(F.first("raw").alias("raw"), F.min("vec_id").alias("rep"), F.count("*").alias("times")).withColumn("cls", F.monotonically_increasing_id()))
    rows = classes.count()
    picked = sorted(r["raw"] for r in bounded_sample(classes, "key", SAMPLE).select("raw").collect())
    index = fit(unit(doubles(picked, dim)), rows, cosine, recall)
    placed = classes.select("cls", "times", "raw").mapInArrow(functools.partial(_visits, index=spark.sparkContext.broadcast(index), dim=dim), "cls long, times long, raw binary, cells array<int>")
    found = cut(_dealt(placed).mapInArrow(functools.partial(_linked, cosine=cosine, dim=dim), "cls long, n long, root long"))
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    comp = connected_components(found.select("cls", "root"), "cls", "root").withColumnRenamed("node", "cls")
    named = classes.select("key", "cls", "rep", "times").join(links, "cls", "left").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("key", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    linked = good.select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    return linked.union(alone).select("*", kept)


def _dealt(placed: DataFrame) -> DataFrame:
    """(cell, bi, bj, blk, cls, times, raw, cells), a row for each cell a class comes to, sorted by the first three.

    More than ``BLOCK`` residents of a cell are dealt into ``homes`` blocks, and visitors into slices, so that a
    hot cell costs rows, not a task. Blocks and slices are numbered alike, below ``parts``; a resident goes to every
    pair its block is in, a visitor to its slice's pairs with blocks of residents.
    """
    spark = placed.sparkSession
    come = placed.withColumn("cell", F.explode("cells"))
    lives = F.col("cell") == F.col("cells")[0]
    count = come.groupBy("cell").agg(F.ceil(F.sum(lives.cast("int")) / BLOCK).cast("int").alias("homes"), F.ceil(F.sum((~lives).cast("int")) / SLICE).cast("int").alias("slices"))
    other = count.filter("homes <> 1 or slices > 1").select("cell", "homes", F.greatest("homes", "slices").alias("parts")).collect()  # at most CENTRES ** 2 narrow rows
    names = ["cell", "bi", "bj", "blk", "cls", "times", "raw", "cells"]
    if not other:
        come = come.select("cell", *[F.lit(0).alias(c) for c in names[1:4]], *names[4:])
    else:
        come = come.join(F.broadcast(spark.createDataFrame(other, "cell int, homes int, parts int")), "cell", "left").fillna(1, ["homes", "parts"])
        come = come.filter("homes > 0")  # where nobody lives, visitors meet nobody
        blk = F.pmod(F.xxhash64("cls"), F.when(lives, F.col("homes")).otherwise(F.col("parts"))).cast("int")
        come = come.withColumn("blk", blk).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(lives, F.col("parts")).otherwise(F.col("homes")) - 1)))
        come = come.select("cell", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), *names[3:])
    return come.repartition("cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj").select(names)


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
