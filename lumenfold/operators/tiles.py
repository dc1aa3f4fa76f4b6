"""Who owns which tile of the mosaic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the ownership rules: motion and focus differences that decide, tiles that make an owner established, and how much nearer a centre must be.
MOTION, FOCUS, ESTABLISHED, NEARER = 50.0, 1000.0, 12, 25.0


def challenge(owner: Column, c: Column) -> Column:
    """Whether challenger ``c`` takes a tile from ``owner`` (null: free), by motion, then focus, then distance.

    Structs with motion, focus, d2 (squared distance of the frame's centre to the tile's, in tiles). This is
    the rule without the count of tiles owned, which needs all tiles at once: see ``compete``.
    """
    dm, df = c["motion"] - owner["motion"], c["focus"] - owner["focus"]
    near = owner["d2"] > F.lit(NEARER) + c["d2"]
    return F.when(owner.isNull(), True).when(F.abs(dm) >= MOTION, dm < 0).when(F.abs(df) >= FOCUS, df > 0).otherwise(near)


def tile_owner(candidates: DataFrame, by: list[str]) -> DataFrame:
    """(by..., owner) by an ordered fold of ``challenge`` over each tile's candidates in frame order.

    The rules are not transitive, so the order is part of the result. A tile's candidates are the frames
    that cover it, a bounded number.
    """
    item = F.struct("frame", "motion", "focus", "d2")
    folded = F.aggregate(F.array_sort(F.collect_list(item)), F.lit(None).cast("struct<frame:bigint,motion:double,focus:double,d2:double>"), lambda o, c: F.when(challenge(o, c), c).otherwise(o))
    return candidates.withColumn("frame", F.col("frame").cast("long")).withColumn("motion", F.col("motion").cast("double")).withColumn("focus", F.col("focus").cast("double")).withColumn("d2", F.col("d2").cast("double")).groupBy(*by).agg(folded["frame"].alias("owner"))


class Competition:
    """Sequential competition over one component's tiles, with the rule on established owners."""

    def __init__(self) -> None:
        self.owner: dict[tuple, tuple] = {}
        self.owned: dict[int, int] = {}

    def offer(self, tile: tuple, frame: int, motion: float, focus: float, d2: float) -> bool:
        """Whether the frame takes the tile."""
        now = self.owner.get(tile)
        if now is not None and not self._beats(now, (frame, motion, focus, d2)):
            return False
        if now is not None:
            self.owned[now[0]] -= 1
        self.owner[tile] = (frame, motion, focus, d2)
        self.owned[frame] = self.owned.get(frame, 0) + 1
        return True

    def _beats(self, now: tuple, new: tuple) -> bool:
        if abs(new[1] - now[1]) >= MOTION:
            return new[1] < now[1]
        if abs(new[2] - now[2]) >= FOCUS:
            return new[2] > now[2]
        if self.owned.get(now[0], 0) < ESTABLISHED < self.owned.get(new[0], 0):
            return True
        return now[3] > NEARER + new[3]


def compete(candidates: DataFrame, component: str) -> DataFrame:
    """(component, i, j, owner): the whole rule, component by component, frames in order of their index."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        c = Competition()
        for r in part.sort_values(["frame", "i", "j"]).itertuples():
            c.offer((r.i, r.j), r.frame, r.motion, r.focus, r.d2)
        rows = [(part[component].iloc[0], i, j, o[0]) for (i, j), o in c.owner.items()]
        return pd.DataFrame(rows, columns=[component, "i", "j", "owner"])

    kind = f"{component} {candidates.schema[component].dataType.simpleString()}, i int, j int, owner long"
    return candidates.groupBy(component).applyInPandas(run, kind)


def smooth_owners(tiles: DataFrame, centres: DataFrame, by: str) -> DataFrame:
    """One simultaneous round of 8-neighbour majority, with a vote more for the incumbent; ties go to the
    owner whose centre is nearest the tile, then the smaller id.

    ``tiles``: (by, i, j, owner); ``centres``: (by, owner, cx, cy) in tile units.
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]))
    seen = tiles.select(by, "owner", (F.col("i")).alias("i0"), F.col("j").alias("j0"), around.alias("o")).select(by, "owner", (F.col("i0") + F.col("o.i")).alias("i"), (F.col("j0") + F.col("o.j")).alias("j"))
    seen = seen.join(tiles.select(by, "i", "j"), [by, "i", "j"], "left_semi")
    votes = seen.unionByName(tiles.select(by, "i", "j", "owner"))
    n = votes.groupBy(by, "i", "j", "owner").agg(F.count("*").alias("n")).join(centres, [by, "owner"])
    d2 = (F.col("cx") - F.col("i") - 0.5) ** 2 + (F.col("cy") - F.col("j") - 0.5) ** 2
    best = Window.partitionBy(by, "i", "j").orderBy(F.desc("n"), d2, "owner")
    return n.withColumn("r", F.row_number().over(best)).filter("r = 1").select(by, "i", "j", "owner")


def contributing_frames(tiles: DataFrame, by: str) -> DataFrame:
    return tiles.filter("owner is not null").select(by, "owner").distinct()


def neighbour_owners(tiles: DataFrame, by: str, diagonal: bool = False) -> DataFrame:
    """Unordered distinct pairs of owners of adjacent tiles: by edge, or by corner with ``diagonal``."""
    steps = [(1, 1), (1, -1)] if diagonal else [(1, 0), (0, 1)]
    to = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    moved = tiles.select(by, F.col("owner").alias("o2"), F.col("i").alias("i0"), F.col("j").alias("j0"), to.alias("s")).select(by, "o2", (F.col("i0") + F.col("s.i")).alias("i"), (F.col("j0") + F.col("s.j")).alias("j"))
    j = tiles.join(moved, [by, "i", "j"]).filter("owner <> o2")
    return j.select(by, F.least("owner", "o2").alias("a"), F.greatest("owner", "o2").alias("b")).distinct()


def nearest_owner(tiles: DataFrame, centres: DataFrame, by: str) -> DataFrame:
    """Voronoi ownership: each tile to the nearest centre of the frames that cover it."""
    d2 = (F.col("cx") - F.col("i") - 0.5) ** 2 + (F.col("cy") - F.col("j") - 0.5) ** 2
    return tiles.join(centres, [by, "frame"]).groupBy(by, "i", "j").agg(F.min_by("frame", F.struct(d2, "frame")).alias("owner"))


def rebuild_changes(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """What a rebuild must render or blank: (by..., owner, action)."""
    o = old.withColumnRenamed("owner", "was")
    j = o.join(new, by, "full_outer").filter(~F.col("was").eqNullSafe(F.col("owner")))
    return j.withColumn("action", F.when(F.col("owner").isNull(), "blank").otherwise("render")).select(*by, "owner", "action")


def inspect(tiles: DataFrame, covering: DataFrame, by: list[str]) -> DataFrame:
    """(by..., owner, frames): a tile's owner and the frames that cover it, newest first."""
    c = covering.groupBy(*by).agg(F.reverse(F.array_sort(F.collect_set("frame"))).alias("frames"))
    return tiles.join(c, by, "left")


def tile_class(tiles: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """Class of each tile, -1 where it has none."""
    return tiles.join(classes, by, "left").withColumn("class", F.coalesce("class", F.lit(-1)))

