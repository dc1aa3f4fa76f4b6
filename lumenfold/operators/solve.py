"""Planar bundle adjustment: positions of frames and landmarks from observed offsets.

Minimises the sum of (landmark - frame - offset)^2 for each axis, with one frame fixed, by conjugate
gradients with a Jacobi preconditioner. ``solve_components`` solves each component in one task (a
component is a mosaic of some hundred frames); ``solve_distributed`` keeps vectors and equations in
DataFrames, for one component that outgrows a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

ITERATIONS, TOLERANCE = 30, 1e-10


def conjugate_gradients(a: np.ndarray, b: np.ndarray, offset: np.ndarray, n: int, fixed: int, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, start: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """Least-squares x of the equations x[b] - x[a] = offset with x[fixed] kept; also the residual norms."""
    free = np.ones(n, bool)
    free[fixed] = False

    def normal(v: np.ndarray) -> np.ndarray:
        r = v[b] - v[a]
        return np.bincount(b, r, n) - np.bincount(a, r, n)

    x = np.zeros(n) if start is None else start.astype(float).copy()
    degree = (np.bincount(a, minlength=n) + np.bincount(b, minlength=n)).astype(float)
    scale = np.where(degree > 0, 1 / np.maximum(degree, 1), 0.0) * free
    r = (np.bincount(b, offset, n) - np.bincount(a, offset, n) - normal(x)) * free
    z = scale * r
    p, rz, norms = z.copy(), float(r @ z), [float(np.sqrt(r @ r))]
    for _ in range(iterations):
        if rz <= tolerance:
            break
        q = normal(p) * free
        step = rz / float(p @ q)
        x += step * p
        r -= step * q
        z = scale * r
        new = float(r @ z)
        p = z + new / rz * p
        rz = new
        norms.append(float(np.sqrt(r @ r)))
    return x, norms


def solve_components(observations: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(component, node, x, y) from (component, frame, landmark, dx, dy); frames are nodes >= 0, landmarks
    come out as -1 - landmark. Each component's smallest frame stays at (0, 0)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        frames, fi = np.unique(part["frame"].to_numpy(), return_inverse=True)
        marks, mi = np.unique(part["landmark"].to_numpy(), return_inverse=True)
        n = len(frames) + len(marks)
        x, y = (conjugate_gradients(fi, mi + len(frames), part[c].to_numpy(), n, 0, iterations)[0] for c in ("dx", "dy"))
        return pd.DataFrame({"component": part["component"].iloc[0], "node": np.concatenate([frames, -1 - marks]), "x": x, "y": y})

    return observations.groupBy("component").applyInPandas(run, "component long, node long, x double, y double")


def solve_distributed(equations: DataFrame, fixed: int, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, x) of x[b] - x[a] = offset from (a, b, offset); nodes of one connected component, ``fixed`` at 0.

    Two joins and one aggregate a round; only two numbers a round reach the driver.
    """
    eq = cut(equations.select("a", "b", F.col("offset").cast("double").alias("offset")))
    ends = lambda r: F.explode(F.array(F.struct(F.col("b").alias("node"), r.alias("v")), F.struct(F.col("a").alias("node"), (-r).alias("v"))))
    free = F.when(F.col("node") == fixed, 0.0).otherwise(1.0)
    first = eq.select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("offset").alias("v")), F.struct(F.col("a").alias("node"), (-F.col("offset")).alias("v")))).alias("e"))
    state = first.groupBy("e.node").agg((F.sum("e.v")).alias("r"), F.count("*").alias("degree"))
    state = state.withColumn("r", F.col("r") * free).withColumn("z", F.col("r") / F.col("degree")).withColumn("p", F.col("z")).withColumn("x", F.lit(0.0))
    state = cut(state)
    rz = state.agg(F.sum(F.col("r") * F.col("z"))).first()[0] or 0.0
    for _ in range(iterations):
        if rz <= tolerance:
            break
        p = state.select("node", "p")
        pa, pb = p.select(F.col("node").alias("a"), F.col("p").alias("pa")), p.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        q = eq.join(pa, "a").join(pb, "b").select(ends(F.col("pb") - F.col("pa")).alias("e")).groupBy("e.node").agg(F.sum("e.v").alias("q"))
        state = cut(state.join(q, "node").withColumn("q", F.col("q") * free))
        step = rz / state.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        state = state.withColumn("x", F.col("x") + step * F.col("p")).withColumn("r", F.col("r") - step * F.col("q")).withColumn("z", F.col("r") / F.col("degree"))
        new = state.agg(F.sum(F.col("r") * F.col("z"))).first()[0]
        state = cut(state.withColumn("p", F.col("z") + new / rz * F.col("p")).drop("q"))
        rz = new
    return state.select("node", "x")
