"""Incremental alignment: what one batch of new frames adds to the tracks known so far."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import estimated_position
from .graph import cut, greedy_cover, observation_key, tracks
from .matching import mutual_matches
from .spatial import grid_query

#: Candidates asked for with and without an estimated position.
NEAR, WIDE = 4, 6


class Aligned(NamedTuple):
    positions: DataFrame
    candidates: DataFrame
    observed: DataFrame


def search_boxes(images: DataFrame, estimates: DataFrame) -> DataFrame:
    """(q, x, y, w, h, valid): a frame's own size at its estimated place, else twice that around its given place."""
    e = estimates.select("frame", F.col("x").alias("_x"), F.col("y").alias("_y"), "valid")
    j = images.join(e, "frame", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    place = lambda c, size: F.when(F.col("valid"), F.col(f"_{c}")).otherwise(F.col(c) - F.col(size) / 2).alias(c)
    side = lambda c: F.when(F.col("valid"), F.col(c)).otherwise(F.col(c) * 2).alias(c)
    return j.select(F.col("frame").alias("q"), place("x", "w"), place("y", "h"), side("w"), side("h"), "valid")


def align_batch(images: DataFrame, wins: DataFrame, keypoints: DataFrame, observed: DataFrame, places: DataFrame, ratio: float = 0.75) -> Aligned:
    """Joins a batch of frames to the tracks: winning matches first, then matches with the frames that see most else.

    ``images``: (frame, x, y, w, h) as the vote placed them; ``wins``: (src, dst, src_kp, dst_kp) from known to new
    frames, none for a frame without a winner; ``keypoints``: (frame, kp, x, y, desc) of both; ``observed``:
    (track, frame, kp); ``places``: (track, x, y, live, solved).

    ``positions``: (q, x, y, w, h, valid), the searched boxes; ``candidates``: (frame, turn, item, gain), at most
    four with an estimate, six without, frames already matched and the tracks they see left out; ``observed``:
    (frame, kp, track, conflict) over old and new matches. Frames of one batch aren't matched to each other. No
    rows in any input give no rows of what depends on it.
    """
    pinned = wins.join(observed, (wins["src"] == observed["frame"]) & (wins["src_kp"] == observed["kp"])).select(F.col("dst").alias("frame"), F.col("dst_kp").alias("kp"), "track")
    at = keypoints.select("frame", "kp", F.col("x").alias("obs_x"), F.col("y").alias("obs_y"))
    known = places.select("track", F.col("x").alias("track_x"), F.col("y").alias("track_y"), "live", "solved")
    boxes = cut(search_boxes(images, estimated_position(pinned.join(at, ["frame", "kp"]).join(known, "track"))))

    points = places.select(F.col("track").alias("id"), "x", "y", F.col("live").alias("active"))
    seen = grid_query(points, boxes, refine=True).select(F.col("q").alias("frame"), F.col("id").alias("element"))
    matched = wins.select(F.col("dst").alias("frame"), F.col("src").alias("item")).distinct()
    views = observed.select(F.col("frame").alias("item"), F.col("track").alias("element")).distinct()
    open_ = seen.join(matched.join(views, "item"), ["frame", "element"], "left_anti")
    covers = open_.join(views, "element").join(matched, ["frame", "item"], "left_anti").filter("item <> frame").select("frame", "item", "element")
    most = boxes.select(F.col("q").alias("frame"), F.when(F.col("valid"), NEAR).otherwise(WIDE).alias("most"))
    chosen = cut(greedy_cover(covers, "frame", WIDE).join(most, "frame").filter("turn <= most").drop("most"))

    found = mutual_matches(keypoints, chosen.select(F.col("item").alias("src"), F.col("frame").alias("dst")), ratio)
    w = Window.partitionBy("track").orderBy("frame", "kp")
    old = observed.select(F.first("frame").over(w).alias("src"), F.col("frame").alias("dst"), F.first("kp").over(w).alias("src_kp"), F.col("kp").alias("dst_kp"))
    links = [m.select(*[F.col(c).cast("long").alias(c) for c in ("src", "dst", "src_kp", "dst_kp")]) for m in (old, wins, found)]
    grown = cut(tracks(links[0].union(links[1]).union(links[2])))
    alone = observed.select("frame", "kp").join(grown, ["frame", "kp"], "left_anti")  # seen once so far: in no link
    return Aligned(boxes, chosen, grown.union(alone.select("frame", "kp", observation_key("frame", "kp").alias("track"), F.lit(False).alias("conflict"))))
