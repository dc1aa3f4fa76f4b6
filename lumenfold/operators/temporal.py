"""Operators over ordered frames, times and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dilate_dark(frames: DataFrame, dark: str, order: str, reach: int = 3, by: list[str] | None = None) -> DataFrame:
    """``valid``: no dark frame within ``reach`` index steps, so gaps in the index are gaps.

    Dark frames are few: each marks the indexes around it and frames are joined to the marks, so one long
    capture is not one window.
    """
    by = by or []
    marks = F.explode(F.sequence(F.col(order) - reach, F.col(order) + reach))
    hit = frames.filter(F.col(dark)).select(*by, marks.alias(order)).distinct().withColumn("_hit", F.lit(True))
    return frames.join(hit, [*by, order], "left").withColumn("valid", F.col("_hit").isNull()).drop("_hit")


def navigation_paths(frames: DataFrame, by: str, order: list[str], mag: str, skip: Column | None = None) -> DataFrame:
    """Adds ``path``: the running number of magnification runs; rows where ``skip`` holds are left out but still break runs."""
    w = Window.partitionBy(by).orderBy(*order)
    new = (~F.col(mag).eqNullSafe(F.lag(mag).over(w))).cast("int")
    out = frames.withColumn("path", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out if skip is None else out.filter(~skip)


def path_distance(points: DataFrame, by: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """(by..., n, total, per_frame): steps summed and divided by one less than their number; 0 when that is not positive."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.sqrt((F.col(x) - F.lag(x).over(w)) ** 2 + (F.col(y) - F.lag(y).over(w)) ** 2)
    sums = points.withColumn("_s", step).groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("total"))
    return sums.withColumn("per_frame", F.when(F.col("n") > 2, F.col("total") / (F.col("n") - 2)).otherwise(F.lit(0.0)))


def path_section(points: DataFrame, by: list[str], order: list[str], fraction: float, length: int) -> DataFrame:
    """Rows at places [start, start + length), start = int(fraction * (n - length)), clamped to the path."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    start = F.greatest((F.lit(fraction) * (n - length)).cast("int"), F.lit(0))
    out = points.withColumn("place", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_start", start)
    return out.filter((F.col("place") >= F.col("_start")) & (F.col("place") < F.col("_start") + length)).drop("_start")


def path_history(points: DataFrame, by: list[str], order: list[str], at: Column, share: float) -> DataFrame:
    """Rows at places [int((1 - share) * at), at]: the part of a path that leads to an annotation."""
    out = points.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("_at", at)
    return out.filter((F.col("place") >= ((1 - F.lit(share)) * F.col("_at")).cast("int")) & (F.col("place") <= F.col("_at"))).drop("_at")


def interval_to_frames(queries: DataFrame, frames: DataFrame, by: str) -> DataFrame:
    """As-of both ways: ``first`` is the last frame at or before ``t0`` (else the first one), ``last`` the first
    at or after ``t1`` (else the last one).

    ``queries``: (by, q, t0, t1); ``frames``: (by, frame, t). Times of both are merged in one sort per key, so
    neither side is repeated.
    """
    f = frames.select(by, F.col("t"), F.col("frame"), F.lit(None).cast("long").alias("q"), F.lit(0).alias("side"))
    lo = queries.select(by, F.col("t0").alias("t"), F.lit(None).cast("long").alias("frame"), "q", F.lit(1).alias("side"))
    hi = queries.select(by, F.col("t1").alias("t"), F.lit(None).cast("long").alias("frame"), "q", F.lit(-1).alias("side"))
    rows = f.union(lo).union(hi)
    # at one time: interval ends, then frames (smallest first), then interval starts
    order = Window.partitionBy(by).orderBy("t", "side", "frame")
    before = F.last("frame", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("frame", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    first_, last_ = (F.first("frame", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("frame", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    seen = rows.withColumn("first", F.coalesce(before, first_)).withColumn("last", F.coalesce(after, last_)).filter("side <> 0")
    return seen.groupBy(by, "q").agg(F.max(F.when(F.col("side") == 1, F.col("first"))).alias("first"), F.max(F.when(F.col("side") == -1, F.col("last"))).alias("last"))


def last_resolved(frames: DataFrame, by: str, order: list[str], frame: str, resolved: Column, crossed: Column) -> DataFrame:
    """``previous``: the latest earlier resolved frame; ``crossed_bad``: whether a frame with ``crossed`` lies between."""
    w = Window.partitionBy(by).orderBy(*order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    out = frames.withColumn("previous", F.last(F.when(resolved, F.col(frame)), ignorenulls=True).over(earlier))
    out = out.withColumn("_place", F.row_number().over(w))
    out = out.withColumn("_prev", F.max(F.when(resolved, F.col("_place"))).over(earlier)).withColumn("_bad", F.max(F.when(crossed, F.col("_place"))).over(earlier))
    return out.withColumn("crossed_bad", F.coalesce(F.col("_bad") > F.coalesce("_prev", F.lit(0)), F.lit(False))).drop("_place", "_prev", "_bad")


def minimum_spacing(points: DataFrame, by: str, order: list[str], x: str, y: str, spacing: float) -> DataFrame:
    """(by, kept): places of a path, each at least ``spacing`` from the last one kept. A sequential fold per path."""
    item = F.struct(*order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    path = points.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("p"))
    zero = F.struct(F.array().cast("array<double>").alias("at"), F.array().cast("array<bigint>").alias("kept"), F.lit(0).cast("long").alias("i"))

    def step(acc: Column, p: Column) -> Column:
        far = (F.size(acc["at"]) == 0) | ((p["_x"] - F.get(acc["at"], F.lit(0))) ** 2 + (p["_y"] - F.get(acc["at"], F.lit(1))) ** 2 >= spacing**2)
        return F.struct(F.when(far, F.array(p["_x"], p["_y"])).otherwise(acc["at"]).alias("at"), F.when(far, F.concat(acc["kept"], F.array(acc["i"]))).otherwise(acc["kept"]).alias("kept"), (acc["i"] + 1).alias("i"))

    return path.select(by, F.aggregate("p", zero, step)["kept"].alias("kept"))


def motion_blur(frames: DataFrame, positions: DataFrame, still: float = 10.0) -> DataFrame:
    """Squared displacement to the frame matched to; roots get 1e7. ``sharp`` marks those still enough to measure focus.

    ``frames``: (frame, matched_to, x, y); ``positions``: (frame, x, y).
    """
    p = positions.select(F.col("frame").alias("matched_to"), F.col("x").alias("_px"), F.col("y").alias("_py"))
    blur = F.coalesce((F.col("x") - F.col("_px")) ** 2 + (F.col("y") - F.col("_py")) ** 2, F.lit(1e7))
    return frames.join(p, "matched_to", "left").withColumn("motion_blur", blur).withColumn("sharp", F.col("motion_blur") < still).drop("_px", "_py")


def project_velocity(frames: DataFrame, by: str, order: list[str], x: str) -> DataFrame:
    """Next place at constant velocity: twice the last less the one before."""
    w = Window.partitionBy(by).orderBy(*order)
    return frames.withColumn("projected", 2 * F.lag(x, 1).over(w) - F.lag(x, 2).over(w))


def prune_components(frames: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """``suspended`` marks frames of components with fewer than ``least`` members."""
    return frames.withColumn("suspended", F.count("*").over(Window.partitionBy(*by)) < least)


def fill_positions(frames: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Final position of every frame: its own if aligned; else its matched predecessor's plus the relative
    offset it was matched with; bad frames take the latest earlier position and component -1.

    ``frames``: (by, frame, state in aligned/unaligned/bad, x, y, matched_to, rel_x, rel_y).
    """
    p = frames.filter("state = 'aligned'").select(by, F.col("frame").alias("matched_to"), F.col("x").alias("_px"), F.col("y").alias("_py"))
    out = frames.join(p, [by, "matched_to"], "left")
    x = F.when(F.col("state") == "aligned", F.col("x")).when(F.col("state") == "unaligned", F.col("_px") - F.col("rel_x"))
    y = F.when(F.col("state") == "aligned", F.col("y")).when(F.col("state") == "unaligned", F.col("_py") - F.col("rel_y"))
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("fx", x).withColumn("fy", y).withColumn("fx", F.last("fx", ignorenulls=True).over(w)).withColumn("fy", F.last("fy", ignorenulls=True).over(w))
    return out.withColumn("bad", F.col("state") == "bad").drop("_px", "_py")


def layout_offsets(layers: DataFrame, by: list[str], order: list[str], width: str, gap: float = 500.0) -> DataFrame:
    """Side by side: each layer starts after the widths before it, plus ``gap`` for each."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return layers.withColumn("offset", F.coalesce(F.sum(F.col(width) + gap).over(w), F.lit(0.0)))


def latest_state(frames: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest row's columns, by key."""
    return frames.groupBy(by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("s")).select(by, "s.*")


def frames_per_ms(frames: DataFrame, index: str, t_ms: Column) -> DataFrame:
    """Largest index over the capture's length in ms; null for a capture of no length."""
    return frames.agg((F.max(index) / F.nullif(F.max(t_ms) - F.min(t_ms), F.lit(0))).alias("frames_per_ms"))


def neighbours_complete(frames: DataFrame, by: str, index: str, reach: int = 3) -> DataFrame:
    """``complete``: all indexes from max(0, i - reach) to i + reach have reported (the batch form of the gate)."""
    w = Window.partitionBy(by).orderBy(index).rangeBetween(-reach, reach)
    return frames.withColumn("complete", F.count("*").over(w) == F.col(index) + reach - F.greatest(F.col(index) - reach, F.lit(0)) + 1)


def pause_punctuation(words: DataFrame, by: str, order: list[str], word: str, start: str, end: str, gap_ms: int = 2000) -> DataFrame:
    """(by, text): the words joined, with a comma after a pause longer than ``gap_ms`` and a period at the end.

    A word that already ends in punctuation gets neither.
    """
    w = Window.partitionBy(by).orderBy(*order)
    pause = F.lead(start).over(w) - F.col(end)
    bare = ~F.col(word).rlike(r"[.,;:!?]$")
    mark = F.when(F.lead(F.lit(1)).over(w).isNull() & bare, ".").when((pause > gap_ms) & bare, ",").otherwise("")
    spoken = words.select(by, *order, F.concat(F.col(word), mark).alias("_w"))
    return spoken.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, "_w"))).alias("p")).select(by, F.array_join(F.transform("p", lambda p: p["_w"]), " ").alias("text"))
