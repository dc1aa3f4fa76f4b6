"""Resolving a frame's position from the votes of its matched predecessors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ready(votes: DataFrame, least: int = 50) -> DataFrame:
    """(grp, total): groups whose votes hold more than ``least`` inliers together."""
    return votes.groupBy("grp").agg(F.sum("inliers").alias("total")).filter(F.col("total") > least)


def resolve_votes(votes: DataFrame, radius: float, quorum: int = 3) -> DataFrame:
    """(grp, vote_id, x, y, n_near, score, clustered) from votes (grp, vote_id, x, y, inliers).

    A vote's neighbourhood is the votes of its group within ``radius`` of it, itself included. Among votes
    with at least ``quorum`` neighbours the one with the highest summed inliers wins; ties go to more own
    inliers, then the smaller id. With no such vote, the vote with most inliers wins. Votes meet through a
    grid of ``radius`` cells, so a large group is not compared with itself whole.
    """
    cell = votes.withColumn("cx", F.floor(F.col("x") / radius).cast("long")).withColumn("cy", F.floor(F.col("y") / radius).cast("long"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    seen = cell.select("grp", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("inliers").alias("oi"), "cx", "cy", around.alias("o"))
    seen = seen.select("grp", "ox", "oy", "oi", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    close = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 <= radius**2
    near = cell.join(seen, ["grp", "cx", "cy"]).filter(close)
    scored = near.groupBy("grp", "vote_id", "x", "y", "inliers").agg(F.count("*").alias("n_near"), F.sum("oi").alias("score"))
    good = F.col("n_near") >= quorum
    order = Window.partitionBy("grp").orderBy(F.desc(good), F.desc(F.when(good, F.col("score"))), F.desc("inliers"), "vote_id")
    best = scored.withColumn("r", F.row_number().over(order)).filter("r = 1")
    return best.select("grp", "vote_id", "x", "y", "n_near", "score", good.alias("clustered"))


def position_from(vote_x: str, vote_y: str, t_x: str, t_y: str):
    """A voter's position less the match's translation, cut to whole pixels."""
    return [(F.col(a) - F.col(t)).cast("int") for a, t in ((vote_x, t_x), (vote_y, t_y))]
