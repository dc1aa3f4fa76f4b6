"""Keypoint matching between frames, and what follows from matches.

Distances are taken inside one Arrow-fed numpy kernel per frame pair, so only matches leave it; pairs
of frames come from a table the caller bounds (predecessors in a window, chosen targets, same label).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 2048


def pack_signs(vector: str) -> Column:
    """Signs of a vector of at most 64 components as one BIGINT, the last component lowest."""
    return F.aggregate(vector, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))


def frame_pairs(frames: DataFrame, window: int | None = None, same: str | None = None) -> DataFrame:
    """(src, dst) with src < dst from (frame[, same]); at most ``window`` apart; labels equal where both are known."""
    label = [F.col(same).alias("l")] if same else [F.lit(None).cast("string").alias("l")]
    a, b = frames.select(F.col("frame").alias("src"), *[c.alias("la") for c in label]), frames.select(F.col("frame").alias("dst"), *[c.alias("lb") for c in label])
    if window is None:
        near = a.join(b, F.col("src") < F.col("dst"))
    else:
        steps = a.withColumn("dst", F.explode(F.sequence(F.col("src") + 1, F.col("src") + window)))
        near = steps.join(b, "dst")
    ok = F.col("la").isNull() | F.col("lb").isNull() | (F.col("la") == F.col("lb"))
    return near.filter(ok).select("src", "dst")


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)).astype(np.float64)


def _euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def _two_nearest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, distance: Callable) -> tuple[np.ndarray, ...]:
    """Places and distances of the two nearest rows of ``b``; ties go to the smaller id (``ids`` ascending)."""
    step = max(1, CHUNK * 256 // max(len(b), 1))
    first, second, d1, d2 = [], [], [], []
    for s in range(0, len(a), step):
        d = distance(a[s : s + step], b)
        rows = np.arange(len(d))
        one = d.argmin(axis=1)
        d1.append(d[rows, one])
        d[rows, one] = np.inf
        two = d.argmin(axis=1)
        first.append(one)
        second.append(two)
        d2.append(d[rows, two])
    return tuple(np.concatenate(x) for x in (first, second, d1, d2))


def _keyed_sides(keypoints: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each pair's keypoints, ``side`` 0 for the source frame's and 1 for the target's."""
    k = keypoints.select("frame", "kp", "desc")
    src = pairs.join(k.withColumnRenamed("frame", "src"), "src").withColumn("side", F.lit(0))
    dst = pairs.join(k.withColumnRenamed("frame", "dst"), "dst").withColumn("side", F.lit(1))
    names = ["src", "dst", "side", "kp", "desc"]
    return src.select(names).union(dst.select(names))


def _descriptors(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["desc"].to_list()).astype(np.float64) if part["desc"].dtype == object else part["desc"].to_numpy().astype(np.uint64)


_KNN = "src long, dst long, q long, t1 long, d1 double, t2 long, d2 double"


def knn2(keypoints: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two nearest target keypoints of every source keypoint, pair by pair.

    ``keypoints``: (frame, kp, desc), desc a packed BIGINT (Hamming) or an array (Euclidean). Source
    keypoints whose target frame has fewer than two keypoints are left out.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("kp")
        a, b = part[part["side"] == 0], part[part["side"] == 1]
        if not len(a) or len(b) < 2:
            return pd.DataFrame({c: [] for c in ("src", "dst", "q", "t1", "d1", "t2", "d2")})
        x, y = _descriptors(a), _descriptors(b)
        one, two, d1, d2 = _two_nearest(x, y, b["kp"].to_numpy(), _hamming if x.ndim == 1 else _euclid)
        ids = b["kp"].to_numpy()
        return pd.DataFrame({"src": part["src"].iloc[0], "dst": part["dst"].iloc[0], "q": a["kp"].to_numpy(), "t1": ids[one], "d1": d1, "t2": ids[two], "d2": d2})

    return _keyed_sides(keypoints, pairs).groupBy("src", "dst").applyInPandas(run, _KNN)


def ratio_matches(nearest: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Strictly closer than ``ratio`` times the second nearest."""
    return nearest.filter(F.col("d1") < F.lit(ratio) * F.col("d2"))


def mutual_matches(keypoints: DataFrame, pairs: DataFrame, ratio: float = 0.75) -> DataFrame:
    """(src, dst, src_kp, dst_kp, dist): pairs that pass the ratio test both ways, in one kernel per frame pair."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("kp")
        a, b = part[part["side"] == 0], part[part["side"] == 1]
        none = pd.DataFrame({c: [] for c in ("src", "dst", "src_kp", "dst_kp", "dist")})
        if len(a) < 2 or len(b) < 2:
            return none
        x, y = _descriptors(a), _descriptors(b)
        distance = _hamming if x.ndim == 1 else _euclid
        ai, bi = a["kp"].to_numpy(), b["kp"].to_numpy()
        to, _, d1, d2 = _two_nearest(x, y, bi, distance)
        rows = np.flatnonzero(d1 < ratio * d2)
        if not len(rows):
            return none
        asked = np.unique(to[rows])  # the way back is needed for these only
        back, _, e1, e2 = _two_nearest(y[asked], x, ai, distance)
        at = np.searchsorted(asked, to[rows])
        keep = (e1[at] < ratio * e2[at]) & (back[at] == rows)
        rows = rows[keep]
        return pd.DataFrame({"src": part["src"].iloc[0], "dst": part["dst"].iloc[0], "src_kp": ai[rows], "dst_kp": bi[to[rows]], "dist": d1[rows]})

    return _keyed_sides(keypoints, pairs).groupBy("src", "dst").applyInPandas(run, "src long, dst long, src_kp long, dst_kp long, dist double")


def edge_counts(matches: DataFrame) -> DataFrame:
    """(src, dst, inliers)."""
    return matches.groupBy("src", "dst").agg(F.count("*").alias("inliers"))


def backward_quorum(edges: DataFrame, quorum: int = 100, least: int = 0) -> DataFrame:
    """Predecessors a frame probes, newest first, until more than ``quorum`` inliers are gathered.

    The edge that passes the quorum is kept. ``ok`` tells whether the frame gathers more than ``least``.
    """
    newest = Window.partitionBy("dst").orderBy(F.desc("src"))
    cum = F.sum("inliers").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    e = edges.withColumn("gathered", cum).filter(F.col("gathered") - F.col("inliers") <= quorum)
    return e.withColumn("ok", F.max("gathered").over(Window.partitionBy("dst")) > least)


def first_accepted(edges: DataFrame, most: int = 4) -> DataFrame:
    """Of each frame's accepted edges, the first ``most`` in the order of their source."""
    return edges.withColumn("turn", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).filter(F.col("turn") <= most)


def best_scale(candidates: DataFrame) -> DataFrame:
    """Of the scale pairs (src, dst, turn, ...) tried for an edge, the one with most inliers; the first wins ties."""
    best = F.max_by(F.struct(*[c for c in candidates.columns if c not in ("src", "dst")]), F.struct(F.col("inliers"), -F.col("turn"))).alias("b")
    return candidates.groupBy("src", "dst").agg(best).select("src", "dst", "b.*")


def geometry_gate(h: str = "h", t_x: str = "t_x", t_y: str = "t_y", width: float = 1.0, height: float = 1.0) -> Column:
    """Accepts a 3x3 homography (array, row by row) that is near a translation, and not too long a one."""
    m = [F.get(h, F.lit(i)) for i in range(9)]
    flat = (F.abs(m[6]) <= 1e-3) & (F.abs(m[7]) <= 1e-3)
    straight = (F.abs(m[1]) <= 0.05) & (F.abs(m[3]) <= 0.05)
    even = (F.abs(m[0] - m[4]) <= 0.05) & (F.abs(m[0] - 1) <= 0.05) & (F.abs(m[4] - 1) <= 0.05)
    return flat & straight & even & (F.abs(F.col(t_x)) < width / 1.1) & (F.abs(F.col(t_y)) < height / 1.1)


def consensus_translation(matches: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(src, dst, t_x, t_y, inliers) from correspondences (src, dst, x1, y1, x2, y2): the translation most agree on.

    A deterministic stand-in for random sampling: every correspondence votes for its own displacement and
    the one with most others within ``tolerance`` wins, ties to the smallest displacement.
    """
    d = matches.select("src", "dst", (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    cell = [F.floor(F.col(c) / tolerance).cast("long").alias(f"c{c}") for c in ("dx", "dy")]
    n = d.select("*", *cell)
    near = n.withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    near = near.select("src", "dst", F.col("dx").alias("vx"), F.col("dy").alias("vy"), (F.col("cdx") + F.col("o.i")).alias("cdx"), (F.col("cdy") + F.col("o.j")).alias("cdy")).distinct()
    both = near.join(n, ["src", "dst", "cdx", "cdy"]).filter((F.col("vx") - F.col("dx")) ** 2 + (F.col("vy") - F.col("dy")) ** 2 <= tolerance**2)
    scored = both.groupBy("src", "dst", "vx", "vy").agg(F.count("*").alias("inliers"), F.avg("dx").alias("t_x"), F.avg("dy").alias("t_y"))
    best = Window.partitionBy("src", "dst").orderBy(F.desc("inliers"), "vx", "vy")
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").select("src", "dst", "t_x", "t_y", "inliers")


def _projected(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Points (n, 2) under homographies (..., 3, 3), as (..., n, 2)."""
    with np.errstate(all="ignore"):
        p = x @ np.swapaxes(h[..., :, :2], -1, -2) + h[..., None, :, 2]
        return p[..., :2] / p[..., 2:]


def _fitted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Homographies (..., 3, 3) least squares takes from points ``a`` to ``b``, both (..., n, 2); n of 4 or more."""
    one, nil = np.ones(a.shape[:-1] + (1,)), np.zeros(a.shape[:-1] + (3,))
    p = np.concatenate([a, one], axis=-1)
    rows = np.concatenate([np.concatenate([p, nil, -b[..., :1] * p], -1), np.concatenate([nil, p, -b[..., 1:] * p], -1)], axis=-2)
    vectors = np.linalg.eigh(np.swapaxes(rows, -1, -2) @ rows)[1]
    return vectors[..., 0].reshape(a.shape[:-2] + (3, 3))


def _centred(x: np.ndarray) -> np.ndarray:
    """Similarity (3, 3) that moves points to mean 0 and a mean distance of about 1."""
    mid = x.mean(axis=0)
    s = 1 / max(float(np.sqrt(((x - mid) ** 2).sum(axis=1)).mean()), 1e-12)
    return np.array([[s, 0, -s * mid[0]], [0, s, -s * mid[1]], [0, 0, 1]])


def find_homography(a: np.ndarray, b: np.ndarray, tolerance: float = 3.0, rounds: int = 2000, confidence: float = 0.995, seed: int = 1) -> tuple[np.ndarray | None, int]:
    """(3x3 matrix from ``a`` to ``b`` with a last entry of 1, inliers) by seeded random sampling of four
    correspondences, refitted to all within ``tolerance``; (None, 0) where fewer than four agree."""
    n = len(a)
    if n < 4:
        return None, 0
    ta, tb = _centred(a), _centred(b)
    na, nb = _projected(ta, a), _projected(tb, b)
    back, limit = np.linalg.inv(tb), tolerance**2
    agrees = lambda h: ((_projected(back @ h @ ta, a) - b) ** 2).sum(axis=-1) <= limit
    rng, best, most, done, needed = np.random.default_rng(seed), None, 0, 0, float(rounds)
    block = max(1, min(100, 2_000_000 // n))
    while done < needed:
        pick = rng.integers(0, n, (block, 4))
        fits = agrees(_fitted(na[pick], nb[pick]))
        counts = fits.sum(axis=1)
        top = int(counts.argmax())
        if counts[top] > most:
            best, most = fits[top], int(counts[top])
            miss = 1 - (most / n) ** 4
            needed = min(rounds, np.log(1 - confidence) / np.log(miss)) if 0 < miss < 1 else 0
        done += block
    for _ in range(3):  # more points agree with a fit to many than with one to four
        if best is None or best.sum() < 4:
            return None, 0
        h = _fitted(na[best], nb[best])
        again = agrees(h)
        if (again == best).all():
            break
        best = again
    h = back @ h @ ta
    return (h / h[2, 2], int(best.sum())) if abs(h[2, 2]) > 1e-12 else (None, 0)


def consensus_homography(matches: DataFrame, tolerance: float = 3.0, rounds: int = 2000, confidence: float = 0.995, with_error: bool = False) -> DataFrame:
    """(src, dst, h, inliers) from correspondences (src, dst, x1, y1, x2, y2): the 3x3 homography, row by row.

    With ``with_error`` also the mean distance of inliers from where they are projected. A pair of frames is one
    task's group, bounded by the keypoints of a frame. Rows are ordered first and draws
    seeded, so reruns agree. Correspondences with a null or non-finite coordinate are left out; pairs on which
    no four agree have a null ``h`` and no inliers.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part[["x1", "y1", "x2", "y2"]].to_numpy(float)
        x = x[np.isfinite(x).all(axis=1)]
        x = x[np.lexsort(x.T[::-1])]
        h, inliers = find_homography(x[:, :2], x[:, 2:], tolerance, rounds, confidence)
        out = {"src": part["src"].iloc[:1], "dst": part["dst"].iloc[:1], "h": [None if h is None else h.ravel().tolist()], "inliers": [inliers]}
        if with_error:
            off = np.zeros(0) if h is None else np.linalg.norm(_projected(h, x[:, :2]) - x[:, 2:], axis=1)
            off = off[off <= tolerance]
            out["error"] = [float(off.mean()) if len(off) else None]
        return pd.DataFrame(out)

    kind = "src long, dst long, h array<double>, inliers long" + ", error double" * with_error
    return matches.select("src", "dst", "x1", "y1", "x2", "y2").groupBy("src", "dst").applyInPandas(run, kind)


#: Scales of a frame, at most.
LEVELS = 256


def scale_pair_search(keypoints: DataFrame, pairs: DataFrame, ratio: float = 0.75, tolerance: float = 3.0, least: int = 4) -> DataFrame:
    """(src, dst, turn, src_level, dst_level, inliers, error, h) of each pair's best scales; pairs without any are left out.

    ``keypoints``: (frame, level, scale, kp, x, y, desc), a frame's keypoints found at several scales, in the
    coordinates of that scale; levels are numbered below ``LEVELS``. Every scale of ``src`` is tried with every
    one of ``dst``: two nearest, ratio test, homography on ``least`` matches or more. ``h`` is in coordinates of
    full size. Tries with a mean error over ``tolerance``, or whose ``h`` is not nearly a scaling and a shift, don't
    count. Of the others the one with most inliers is taken, the first (by source, then target level) of equals.
    """
    sub = (F.col("frame") * LEVELS + F.col("level")).cast("long")
    places = keypoints.select(sub.alias("sub"), "kp", "x", "y")
    levels = keypoints.select("frame", "level", "scale").distinct()
    side = lambda name: levels.select(F.col("frame").alias(name), F.col("level").alias(f"{name}_level"), F.col("scale").alias(f"{name}_scale"))
    tries = pairs.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")
    tries = tries.select("*", (F.col("src") * LEVELS + F.col("src_level")).cast("long").alias("a"), (F.col("dst") * LEVELS + F.col("dst_level")).cast("long").alias("b"))
    near = ratio_matches(knn2(keypoints.select(sub.alias("frame"), "kp", "desc"), tries.select(F.col("a").alias("src"), F.col("b").alias("dst"))), ratio)
    points = near.join(places.toDF("src", "q", "x1", "y1"), ["src", "q"]).join(places.toDF("dst", "t1", "x2", "y2"), ["dst", "t1"])
    fits = consensus_homography(points, tolerance, with_error=True).filter((F.col("inliers") >= least) & (F.col("error") <= tolerance))
    full = tries.join(fits.withColumnsRenamed({"src": "a", "dst": "b"}), ["a", "b"]).withColumn("h", _full_size("h", F.col("src_scale"), F.col("dst_scale")))
    turn = (F.col("src_level") * LEVELS + F.col("dst_level")).cast("long").alias("turn")
    return best_scale(full.filter(scaling_gate("h")).select("src", "dst", turn, "src_level", "dst_level", "inliers", "error", "h"))


def _full_size(h: str, src_scale: Column, dst_scale: Column) -> Column:
    """A homography between scaled frames as one between frames of full size, its last entry 1."""
    rows, columns = (1 / dst_scale, 1 / dst_scale, F.lit(1.0)), (src_scale, src_scale, F.lit(1.0))
    m = [F.get(h, F.lit(3 * i + j)) * rows[i] * columns[j] for i in range(3) for j in range(3)]
    return F.when(F.abs(m[8]) >= 1e-12, F.array(*[x / m[8] for x in m]))


def scaling_gate(h: str = "h") -> Column:
    """Accepts a 3x3 homography (array, row by row) with hardly any rotation, shear, unevenness or perspective."""
    m = [F.get(h, F.lit(i)) for i in range(9)]
    mean = (F.abs(m[0]) + F.abs(m[4])) / 2
    even = (mean >= 1e-3) & (F.abs(m[0] - m[4]) <= 0.08 * mean)
    return even & (F.abs(m[1]) <= 0.08) & (F.abs(m[3]) <= 0.08) & (F.abs(m[6]) <= 1e-3) & (F.abs(m[7]) <= 1e-3)
