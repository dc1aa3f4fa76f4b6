"""Frames, components and layers: links, residuals, offsets, spreading and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, cut, dense_ids  # noqa: F401


def split_matches(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges with both ends' components and ``inter``: whether they cross. ``membership``: (frame, component)."""
    a, b = membership.toDF("src", "src_component"), membership.toDF("dst", "dst_component")
    return edges.join(a, "src").join(b, "dst").withColumn("inter", F.col("src_component") != F.col("dst_component"))


def newest_overlaps(frames: DataFrame, by: str, order: str) -> DataFrame:
    """(by, id, newest): earlier frames whose box shares area with the group's newest frame."""
    last = frames.groupBy(by).agg(F.max_by(F.struct("id", "x", "y", "w", "h", order), order).alias("n")).select(by, "n")
    meet = (F.col("x") < F.col("n.x") + F.col("n.w")) & (F.col("n.x") < F.col("x") + F.col("w")) & (F.col("y") < F.col("n.y") + F.col("n.h")) & (F.col("n.y") < F.col("y") + F.col("h"))
    return frames.join(last, by).filter((F.col("id") != F.col("n.id")) & meet).select(by, "id", F.col("n.id").alias("newest"))


def residuals(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """(src, dst, rx, ry): what a match says less what the positions say. Edges: (src, dst, t_x, t_y)."""
    a = positions.select(F.col("frame").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    b = positions.select(F.col("frame").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    j = edges.join(a, "src").join(b, "dst")
    return j.select("src", "dst", (F.col("t_x") - (F.col("sx") - F.col("dx"))).alias("rx"), (F.col("t_y") - (F.col("sy") - F.col("dy"))).alias("ry"))


def count_live(keypoints: DataFrame) -> DataFrame:
    return keypoints.groupBy("frame").agg(F.count_if("live").alias("live"))


def patch_grid(images: DataFrame, patch: int, stride: int = 20) -> DataFrame:
    """(id, x, y): corners of the patches that fit in each image (id, width, height)."""
    span = lambda n: F.when(F.col(n) >= patch, F.sequence(F.lit(0), F.col(n) - patch, F.lit(stride)))
    return images.withColumn("x", F.explode(span("width"))).withColumn("y", F.explode(span("height"))).select("id", "x", "y")


def mean_hypothesis(estimates: DataFrame) -> DataFrame:
    """(frame, x, y, n): mean of the positions its homographies imply."""
    return estimates.groupBy("frame").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def absorb_with_priority(components: DataFrame, links: DataFrame) -> DataFrame:
    """(component, into): joined components go to component 0 where it is among them, else to the largest, ties to the smallest id."""
    c = connected_components(links, "a", "b").withColumnRenamed("component", "grp")
    j = components.join(c, components["component"] == c["node"], "left").withColumn("grp", F.coalesce("grp", components["component"]))
    head = j.groupBy("grp").agg(F.max_by("component", F.struct((F.col("component") == 0).cast("int"), F.col("size"), -F.col("component"))).alias("into"))
    return j.join(head, "grp").select("component", "into")


def spread(edges: DataFrame, seeds: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, seed, steps): breadth-first spread from seeds along undirected edges; nearest seed wins, then the smallest."""
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct())
    done = cut(seeds.select("node", F.col("node").alias("seed"), F.lit(0).alias("steps")).distinct())
    front = done
    for step in range(1, most + 1):
        new = front.join(both, front["node"] == both["a"]).groupBy(F.col("b").alias("node")).agg(F.min("seed").alias("seed")).withColumn("steps", F.lit(step))
        front = cut(new.join(done.select("node"), "node", "left_anti"))
        if not front.limit(1).count():
            return done
        done = cut(done.union(front))
    raise RuntimeError(f"the spread did not end in {most} steps")


def align_layers(layers: DataFrame, pairs: DataFrame, by: str = "slide") -> DataFrame:
    """(by, id, off, via): layers placed from layers already placed, until no more can be.

    ``layers``: (by, id, mag, placed); ``pairs``: (by, id, via, off): offset of ``id`` in the frame of ``via``, a
    layer of another magnification. Of several, the smallest ``via`` is taken.
    """
    done = cut(layers.filter("placed").select(by, "id", F.lit(0.0).alias("off"), F.lit(None).cast("long").alias("via")))
    mags = layers.select(by, "id", "mag")
    p = pairs.join(mags, [by, "id"]).join(mags.select(by, F.col("id").alias("via"), F.col("mag").alias("m2")), [by, "via"]).filter("mag <> m2").select(by, "id", "via", F.col("off").alias("rel"))
    p = cut(p)
    while True:
        ready = p.join(done.select(by, F.col("id").alias("via"), F.col("off").alias("base")), [by, "via"]).join(done.select(by, "id"), [by, "id"], "left_anti")
        new = cut(ready.groupBy(by, "id").agg(F.min_by(F.struct((F.col("base") + F.col("rel")).alias("off"), "via"), "via").alias("s")).select(by, "id", "s.off", "s.via"))
        if not new.limit(1).count():
            return done
        done = cut(done.union(new))


def anchor(features: Column, velocity: Column, label: Column) -> tuple[Column, Column]:
    """A new component's scale and which of the three fallbacks gave it."""
    how = F.when(features.isNotNull(), "features").when(velocity.isNotNull(), "velocity").when(label.isNotNull(), "label")
    return F.coalesce(features, velocity, label), how


def landmark_offset(frames: DataFrame, landmarks: DataFrame, scale: str) -> DataFrame:
    """Component offsets that put each landmark frame where it is known to be. ``landmarks``: (frame, bx, by)."""
    j = frames.join(landmarks, "frame")
    return j.select("component", "frame", (F.col("bx") / F.col(scale) - F.col("x")).alias("off_x"), (F.col("by") / F.col(scale) - F.col("y")).alias("off_y"))


def explode_keypoints(frames: DataFrame, reg_scale: float) -> DataFrame:
    """(frame, kp, x, y, track) from frames with an array ``kps`` of (x, y), scaled to full size; each starts its own track."""
    k = frames.select("frame", F.posexplode("kps").alias("kp", "p"))
    return k.select("frame", "kp", (F.col("p.x") / reg_scale).alias("x"), (F.col("p.y") / reg_scale).alias("y"), (F.col("frame") * 1024 + F.col("kp")).alias("track"))


def translate_tracks(tracks: DataFrame, shifts: DataFrame, by: str) -> DataFrame:
    """Tracks of absorbed components moved and relabelled. ``shifts``: (by, into, t_x, t_y)."""
    j = tracks.join(shifts, by, "left")
    return j.select("track", F.coalesce("into", by).alias(by), (F.col("x") + F.coalesce("t_x", F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce("t_y", F.lit(0.0))).alias("y"))


def frames_of_interval(concepts: DataFrame, frames: DataFrame, by: str) -> DataFrame:
    """(by, q, frame): frames between the first and last of each concept's interval."""
    c = concepts.withColumn("frame", F.explode(F.sequence("first", "last"))).select(by, "q", "frame")
    return c.join(frames.select(by, "frame"), [by, "frame"], "left_semi")


def model_tile(i: Column, j: Column, stride: int, columns: int) -> Column:
    """Id of the overlapping model tile that starts at or before a base tile."""
    return F.floor(j / stride) * columns + F.floor(i / stride)


def owned_vertices(vertices: DataFrame, owners: DataFrame) -> DataFrame:
    """Frames that own triangulation vertices of a component."""
    return vertices.join(owners, ["component", "vertex"]).select("component", "frame").distinct()


#: Parts that the frames of a label are dealt to, at least, to meet its components.
PARTS = 48


def cross_component_pairs(frames: DataFrame, components: DataFrame) -> DataFrame:
    """(frame, target): a frame against every live component of its label but its own.

    ``frames``: (frame, label, component); ``components``: (component, label, suspended).
    """
    live = components.filter("not suspended").select(F.col("component").alias("target"), "label")
    # few labels, and work that grows with pairs, not bytes: frames are dealt to parts, each with all of a label's components
    n = max(PARTS, 4 * frames.sparkSession.sparkContext.defaultParallelism)
    f = frames.select("frame", "label", "component").withColumn("_part", F.pmod(F.xxhash64("frame"), F.lit(n)).cast("int"))
    live = live.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    j = f.repartition(n, "label", "_part").join(live.repartition(n, "label", "_part").hint("merge"), ["label", "_part"])
    return j.filter(F.col("target") != F.col("component")).select("frame", "target")


def feature_cascade(counts: DataFrame, least: int = 250) -> DataFrame:
    """(frame, used, n, quality): the first detector's keypoints, else the fallback's, else too few.

    ``counts``: (frame, n_first, n_fallback).
    """
    first = F.col("n_first") >= least
    n = F.when(first, F.col("n_first")).otherwise(F.col("n_fallback"))
    return counts.select("frame", F.when(first, "first").otherwise("fallback").alias("used"), n.alias("n"), F.when(n < least, "low_features").otherwise("good").alias("quality"))


def tile_batches(tiles: DataFrame, by: str, order: list[str], most: int = 512) -> DataFrame:
    """``batch``: running number of pieces of at most ``most`` tiles of one component, in order."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return tiles.withColumn("batch", F.floor(place / most))


def largest_group(members: DataFrame, by: str, group: str) -> DataFrame:
    """(by, group, size): the largest group of each key, smallest id on ties."""
    n = members.groupBy(by, group).agg(F.count("*").alias("size"))
    return n.groupBy(by).agg(F.max_by(F.struct(group, "size"), F.struct(F.col("size"), -F.col(group))).alias("s")).select(by, "s.*")


def track_positions(observations: DataFrame, positions: DataFrame) -> DataFrame:
    """(track, x, y, n): mean of frame position plus observation."""
    j = observations.join(positions.select("frame", F.col("x").alias("fx"), F.col("y").alias("fy")), "frame")
    return j.groupBy("track").agg(F.avg(F.col("fx") + F.col("x")).alias("x"), F.avg(F.col("fy") + F.col("y")).alias("y"), F.count("*").alias("n"))


def refusing_tracks(matches: DataFrame, by: str) -> DataFrame:
    """(by, track, frame, kp): tracks merged match by match, strongest first; a merge that would give a track
    two keypoints of one frame is refused. One bounded component per key. ``matches``: (by, src, dst, src_kp,
    dst_kp, dist)."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}
        held: dict = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        for r in part.sort_values(["dist", "src", "src_kp", "dst", "dst_kp"]).itertuples():
            a, b = find((r.src, r.src_kp)), find((r.dst, r.dst_kp))
            fa, fb = held.setdefault(a, {a[0]: a}), held.setdefault(b, {b[0]: b})
            if a == b or fa.keys() & fb.keys():
                continue
            a, b = min(a, b), max(a, b)
            root[b] = a
            held[a] = held[a] | held.pop(b)
        names = {a: k for k, a in enumerate(sorted({find(v) for v in list(root)}))}
        rows = [(part[by].iloc[0], names[find(v)], *v) for v in sorted(root)]
        return pd.DataFrame(rows, columns=[by, "track", "frame", "kp"])

    kind = matches.schema[by].dataType.simpleString()
    return matches.groupBy(by).applyInPandas(run, f"{by} {kind}, track long, frame long, kp long")


def segmentation_request(points: Column, lo: Column, hi: Column) -> Column:
    """Clicked points with the view's corners as named fields, not as two more points."""
    return F.struct(points.alias("points"), lo.alias("view_from"), hi.alias("view_to"))
