"""Aggregations: plurality, fits, outliers, histograms, ranked picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plurality(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """Most frequent label by key; ties go to the smallest label."""
    n = rows.groupBy(*by, label).agg(F.count("*").alias("n"))
    top = n.groupBy(*by).agg(F.max("n").alias("n"))
    return n.join(top, [*by, "n"]).groupBy(*by, "n").agg(F.min(label).alias(label))


def mean_translation(matches: DataFrame) -> DataFrame:
    """(lo, hi, t_x, t_y, n): mean translation between component pairs; matches stored the other way round count negated."""
    sign = F.when(F.col("a") <= F.col("b"), 1).otherwise(-1)
    m = matches.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (sign * F.col("t_x")).alias("t_x"), (sign * F.col("t_y")).alias("t_y"))
    return m.groupBy("lo", "hi").agg(F.avg("t_x").alias("t_x"), F.avg("t_y").alias("t_y"), F.count("*").alias("n"))


def estimated_position(observations: DataFrame) -> DataFrame:
    """(frame, x, y, valid) from (frame, track_x, track_y, obs_x, obs_y, live, solved): mean of track less observation."""
    ok = F.col("live") & F.col("solved")
    of = lambda a, b: F.avg(F.when(ok, F.col(a) - F.col(b)))
    return observations.groupBy("frame").agg(of("track_x", "obs_x").alias("x"), of("track_y", "obs_y").alias("y"), (F.count_if(ok) > 0).alias("valid"))


def depth_histogram(observations: DataFrame, track: str) -> DataFrame:
    """(depth, tracks): how many tracks have how many observations."""
    return observations.groupBy(track).agg(F.count("*").alias("depth")).groupBy("depth").agg(F.count("*").alias("tracks"))


def moments(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("deviation"))


def pearson(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Correlation; 0 when either side does not vary."""
    r = F.corr(a, b)
    return rows.groupBy(*by).agg(F.when(r.isNull() | F.isnan(r), F.lit(0.0)).otherwise(r).alias("r"))


def scale_fit(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Least-squares scale of ``a`` onto ``b`` through the origin; 1 when degenerate."""
    num, den = F.sum(F.col(a) * F.col(b)), F.sum(F.col(a) * F.col(a))
    return rows.groupBy(*by).agg(F.when(den > 0, num / den).otherwise(F.lit(1.0)).alias("scale"))


def percentile_bin(rows: DataFrame, value: str, low: float, high: float, share: float, bins: int = 256) -> DataFrame:
    """First of ``bins`` equal bins whose cumulative count reaches ``share`` of all."""
    b = F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).alias("bin")
    hist = rows.filter(F.col(value).isNotNull()).groupBy(b).agg(F.count("*").alias("n"))  # at most ``bins`` rows from here on
    cum = hist.withColumn("cum", F.sum("n").over(Window.orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return cum.filter(F.col("cum") >= F.lit(share) * F.col("all")).agg(F.min("bin").alias("bin"))


def drop_blurred(rows: DataFrame, by: list[str], blur: str, k: float = 1.0) -> DataFrame:
    """Rows whose blur measure is above the group's mean less ``k`` sample deviations."""
    s = rows.groupBy(*by).agg((F.avg(blur) - k * F.stddev_samp(blur)).alias("_floor"))
    return rows.join(s, by).filter(F.col(blur) > F.col("_floor")).drop("_floor")


def top_per_cell(points: DataFrame, cell: float, k: int, x: str, y: str, response: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """The ``k`` strongest keypoints of each grid cell."""
    c = [F.floor(F.col(v) / cell) for v in (x, y)]
    w = Window.partitionBy(*(by or []), *c).orderBy(F.desc(response), tie)
    return points.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def worst_unknown(residuals: DataFrame, by: str) -> DataFrame:
    """(by, node, mean_residual): the unknown with the largest mean squared residual, smallest id on ties.

    ``residuals``: (by, a, b, r): one row an equation between unknowns a and b.
    """
    each = residuals.select(by, F.explode(F.array("a", "b")).alias("node"), "r")
    s = each.groupBy(by, "node").agg(F.avg(F.col("r") * F.col("r")).alias("mean_residual"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("mean_residual"), "node"))).filter("k = 1").drop("k")


def overlap_order(pairs: DataFrame, by: str, scale: str, area: str) -> DataFrame:
    """``turn``: by log scale ratio (rounded to 1e-4, so ties are exact), then larger area, then id."""
    w = Window.partitionBy(by).orderBy(F.round(F.abs(F.log(scale)), 4), F.desc(area), "id")
    return pairs.withColumn("turn", F.row_number().over(w))


def keep_larger(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """``accepted``: larger than everything its key had before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(value).over(w)
    return rows.withColumn("accepted", best.isNull() | (F.col(value) > best))


def radial_slope(rows: DataFrame, by: list[str], r2: str, log_ratio: str) -> DataFrame:
    """Slope through the origin of log ratio on squared radius, and the Gaussian sigma it means."""
    slope = F.sum(F.col(r2) * F.col(log_ratio)) / F.sum(F.col(r2) * F.col(r2))
    return rows.groupBy(*by).agg(slope.alias("slope")).withColumn("sigma", F.when(F.col("slope") < 0, F.sqrt(-2 * F.col("slope"))).otherwise(F.lit(0.0)))


def best_offset(scores: DataFrame, by: list[str], score: str, dx: str, dy: str) -> DataFrame:
    """Offset of the largest score; smallest offset on ties."""
    return scores.groupBy(*by).agg(F.max_by(F.struct(dx, dy, score), F.struct(F.col(score), -F.col(dx), -F.col(dy))).alias("s")).select(*by, "s.*")


def balanced_sample(clicks: DataFrame, by: str, kind: str, order: list[str], most: int = 10) -> DataFrame:
    """At most ``most`` clicks, half of each kind where there are enough; unused places go to the other kind."""
    w = Window.partitionBy(by, kind).orderBy(*order)
    ranked = clicks.withColumn("_r", F.row_number().over(w)).withColumn("_turn", F.row_number().over(Window.partitionBy(by).orderBy("_r", kind)))
    return ranked.filter(F.col("_turn") <= most).drop("_r", "_turn")


def priority_order(rows: DataFrame, clicked: Column, neighbour: Column) -> DataFrame:
    """Embedding order: clicked 0, neighbours 1, others 10."""
    return rows.withColumn("priority", F.when(clicked, 0).when(neighbour, 1).otherwise(10))


def match_matrix(edges: DataFrame, nodes: list[int], value: str | None = None) -> DataFrame:
    """Dense export of a long edge table over a *given* small list of nodes: one row a node, one column a node."""
    both = edges.select(F.col("src").alias("r"), F.col("dst").alias("c"), F.col(value).alias("v") if value else F.lit(1).alias("v"))
    both = both.union(both.select(F.col("c").alias("r"), F.col("r").alias("c"), "v"))
    cells = both.groupBy("r").pivot("c", nodes).agg(F.max("v"))
    spark = edges.sparkSession
    out = spark.createDataFrame([(n,) for n in nodes], "r long").join(cells, "r", "left").fillna(0)
    return out.select(F.col("r").alias("node"), *[F.col(str(n)).alias(f"n{n}") for n in nodes])
