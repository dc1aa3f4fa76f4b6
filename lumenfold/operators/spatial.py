"""Boxes, grids and tiles. Range joins go through grid cells: both sides are dealt to the cells they
touch, joined on the cell, refined, and a pair that shares several cells is kept in its first one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import geometry as g


#: Boxes or members of one cell that meet a cell's other side in one piece; more are dealt out.
BLOCK = 2048
#: Ids of equal boxes that go as one list.
COPIES = 256


def _cells(boxes: DataFrame, cell: float, names: tuple[str, str, str, str]) -> DataFrame:
    x, y, w, h = (F.col(n) for n in names)
    span = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    return boxes.withColumn("cx", F.explode(span(x, x + w))).withColumn("cy", F.explode(span(y, y + h)))


def _dealt_join(l: DataFrame, r: DataFrame, key: list[str], by: str, weight: Column | None = None) -> DataFrame:
    """Equi-join that is never broadcast, in a number of tasks that doesn't follow the bytes: a cell's work grows with
    its pairs. Rows of ``l`` in a crowded cell (by ``weight``, 1 a row) are dealt to parts by a hash of ``by``; the
    cell's rows of ``r`` go to each."""
    conf = l.sparkSession.conf
    n = max(int(conf.get("spark.sql.shuffle.partitions")), 4 * l.sparkSession.sparkContext.defaultParallelism)
    parts = l.groupBy(*key).agg(F.ceil(F.sum(F.lit(1) if weight is None else weight) / BLOCK).cast("int").alias("_parts")).hint("merge")
    l = l.join(parts, key).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop("_parts")
    r = r.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    key = [*key, "_part"]
    return l.repartition(n, *key).join(r.repartition(n, *key).hint("merge"), key).drop("_part")


def overlap_classes(a: DataFrame, b: DataFrame, cell: float, on: list[str] | None = None, closed: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Pairs of boxes of ``a`` and ``b`` that intersect, with the lists ``a_ids`` and ``b_ids`` of those that are equal
    to them in all columns: copies of a box are compared once. ``expand_classes`` makes pairs of ids."""
    on, keep = on or [], keep or []

    def side(d: DataFrame, p: str) -> DataFrame:
        same = d.groupBy(*on, *[F.col(c).alias(p + c) for c in ("x", "y", "w", "h", *keep)]).agg(F.collect_list("id").alias("ids"))
        chunk = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / COPIES).cast("int")), lambda i: F.slice("ids", i * COPIES + 1, F.lit(COPIES)))
        d = same.filter(F.size("ids") > 0).withColumn(p + "ids", F.explode(chunk)).drop("ids")
        return _cells(d, cell, tuple(p + c for c in "xywh")).withColumn(p + "cx", F.floor(F.col(p + "x") / cell)).withColumn(p + "cy", F.floor(F.col(p + "y") / cell))

    j = _dealt_join(side(a, "a_"), side(b, "b_"), [*on, "cx", "cy"], "a_ids", F.size("a_ids"))
    first = (F.col("cx") == F.greatest("a_cx", "b_cx")) & (F.col("cy") == F.greatest("a_cy", "b_cy"))
    less = (lambda p, q: p <= q) if closed else (lambda p, q: p < q)
    meet = less(F.col("a_x"), F.col("b_x") + F.col("b_w")) & less(F.col("b_x"), F.col("a_x") + F.col("a_w")) & less(F.col("a_y"), F.col("b_y") + F.col("b_h")) & less(F.col("b_y"), F.col("a_y") + F.col("a_h"))
    return j.filter(meet & first).drop("cx", "cy", "a_cx", "a_cy", "b_cx", "b_cy")


def expand_classes(pairs: DataFrame) -> DataFrame:
    """A row for each pair of ids, ``a_id`` and ``b_id``, in place of ``a_ids`` and ``b_ids``."""
    return pairs.withColumn("a_id", F.explode("a_ids")).drop("a_ids").withColumn("b_id", F.explode("b_ids")).drop("b_ids")


def overlap_join(a: DataFrame, b: DataFrame, cell: float, on: list[str] | None = None, closed: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Pairs of boxes (id, x, y, w, h) of ``a`` and ``b`` that intersect; ``on``: further equal columns;
    ``keep``: further columns of both that the pairs bring along, as a_ and b_.

    Closed intervals touch; open ones need a shared area. Choose ``cell`` near the usual box size.
    """
    return expand_classes(overlap_classes(a, b, cell, on, closed, keep))


def overlap_scores(pairs: DataFrame, matched: Column) -> DataFrame:
    """``diag_ratio``: shared box's squared diagonal over the first box's (1 for matched pairs); ``area_ratio``: the areas'."""
    w = F.least(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w")) - F.greatest("a_x", "b_x")
    h = F.least(F.col("a_y") + F.col("a_h"), F.col("b_y") + F.col("b_h")) - F.greatest("a_y", "b_y")
    own = F.col("a_w") ** 2 + F.col("a_h") ** 2
    out = pairs.withColumn("diag_ratio", F.when(matched, F.lit(1.0)).otherwise((w * w + h * h) / own))
    return out.withColumn("area_ratio", w * h / (F.col("a_w") * F.col("a_h")))


def member_overlaps(members: DataFrame, by: str, radius: float, round_view: bool, crop: float = 0.5, size: float = 1.0) -> DataFrame:
    """Unordered pairs of one component whose centres are close: by squared distance for round views
    (under int(0.7 r^2)), else by each axis (under (1 - crop) * 0.9 * size)."""
    reach = (int(0.7 * radius**2)) ** 0.5 if round_view else (1 - crop) * 0.9 * size
    m = members.select(by, "id", "x", "y", F.floor(F.col("x") / reach).alias("cx"), F.floor(F.col("y") / reach).alias("cy"))
    # a pair meets once: in its own cell, or in the cell of the one whose neighbour to the right or above the other's is
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))]))
    o = m.select(by, F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", around.alias("o"))
    own = ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own")
    o = o.select(by, "id2", "x2", "y2", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), own)
    j = _dealt_join(m, o, [by, "cx", "cy"], "id").filter(F.when(F.col("own"), F.col("id") < F.col("id2")).otherwise(F.col("id") != F.col("id2")))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    j = j.filter(dx * dx + dy * dy < int(0.7 * radius**2) if round_view else (F.abs(dx) < reach) & (F.abs(dy) < reach))
    return j.select(by, F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2"))


def union_box(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Smallest box around all: (by..., x, y, w, h)."""
    lo = boxes.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    return lo.select(*by, "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"))


def to_origin(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Boxes moved so that the smallest corner of each group is (0, 0)."""
    w = Window.partitionBy(*by)
    return boxes.withColumn("x", F.col("x") - F.min("x").over(w)).withColumn("y", F.col("y") - F.min("y").over(w))


def covered_tiles(frames: DataFrame, size: int = 256, round_view: bool = False) -> DataFrame:
    """(id, i, j, full) for frames (id, x, y, w, h): the tiles each touches, and whether it covers them whole.

    A round view covers a tile whose four corners lie in the circle inscribed in its box, and touches the
    tiles that have at least one corner inside it.
    """
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    last = lambda lo, n: F.greatest(F.ceil((lo + n) / size) - 1, F.floor(lo / size))
    t = frames.withColumn("i", F.explode(F.sequence(F.floor(x / size), last(x, w)))).withColumn("j", F.explode(F.sequence(F.floor(y / size), last(y, h))))
    i, j = F.col("i") * size, F.col("j") * size
    if not round_view:
        return t.select("id", "i", "j", ((i >= x) & (j >= y) & (i + size <= x + w) & (j + size <= y + h)).alias("full"))
    r2 = F.least(w, h) ** 2 / 4
    inside = [F.when((px - x - w / 2) ** 2 + (py - y - h / 2) ** 2 <= r2, 1).otherwise(0) for px in (i, i + size) for py in (j, j + size)]
    corners = inside[0] + inside[1] + inside[2] + inside[3]
    return t.withColumn("corners", corners).filter("corners > 0").select("id", "i", "j", (F.col("corners") == 4).alias("full"))


def grid_query(points: DataFrame, queries: DataFrame, cell: float = 256.0, refine: bool = False) -> DataFrame:
    """(q, id): active points in the cells a box touches; with ``refine`` only those in the box itself."""
    p = points.filter("active").withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    q = _cells(queries.select("q", F.col("x").alias("qx"), F.col("y").alias("qy"), "w", "h"), cell, ("qx", "qy", "w", "h"))
    j = q.join(p, ["cx", "cy"])
    if refine:
        j = j.filter((F.col("x") >= F.col("qx")) & (F.col("x") <= F.col("qx") + F.col("w")) & (F.col("y") >= F.col("qy")) & (F.col("y") <= F.col("qy") + F.col("h")))
    return j.select("q", "id")


def viewport_tiles(tiles: DataFrame, x: float, y: float, w: float, h: float, scale: float, levels: int, size: int = 256) -> DataFrame:
    """Tiles of the level that suits a view scale, inside a view given in base pixels. Filters are plain
    comparisons on partition columns, so they prune."""
    level = min(max(int(math.log2(scale) + 0.5), 0), levels - 1) if scale > 0 else 0
    s = size * 2**level
    lo, hi = (int(x // s), int(y // s)), (int((x + w) // s), int((y + h) // s))
    return tiles.filter((F.col("level") == level) & F.col("i").between(lo[0], hi[0]) & F.col("j").between(lo[1], hi[1]))


def pyramid(tiles: DataFrame, levels: int) -> DataFrame:
    """Adds the parents of (component, i, j) tiles up to ``levels``: (component, level, i, j, children)."""
    base = tiles.select("component", F.lit(0).alias("level"), "i", "j", F.lit(0).cast("long").alias("children")).distinct()
    out, now = base, base
    for level in range(1, levels):
        now = now.groupBy("component", g.parent_index(F.col("i")).alias("i"), g.parent_index(F.col("j")).alias("j")).agg(F.count("*").alias("children")).select("component", F.lit(level).alias("level"), "i", "j", "children")
        out = out.union(now)
    return out


def polygon_tiles(polygons: DataFrame, size: int = 256) -> DataFrame:
    """(id, i, j): tiles a polygon (id, vertices) touches, column by column: per tile column the y range of
    the edges in it."""
    v = F.col("vertices")
    edges = polygons.select("id", F.explode(F.zip_with(v, F.concat(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1)), lambda a, b: F.struct(F.least(a["x"], b["x"]).alias("x1"), F.when(a["x"] <= b["x"], a["y"]).otherwise(b["y"]).alias("y1"), F.greatest(a["x"], b["x"]).alias("x2"), F.when(a["x"] <= b["x"], b["y"]).otherwise(a["y"]).alias("y2")))).alias("e")).select("id", "e.*")
    c = edges.withColumn("i", F.explode(F.sequence(F.floor(F.col("x1") / size), F.floor(F.col("x2") / size))))
    lo, hi = F.greatest(F.col("x1"), F.col("i") * size), F.least(F.col("x2"), (F.col("i") + 1) * size)
    at = lambda x: F.when(F.col("x1") == F.col("x2"), F.lit(None)).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * (x - F.col("x1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0)))
    ends = [F.coalesce(at(lo), F.col("y1")), F.coalesce(at(hi), F.col("y2"))]
    rows = c.groupBy("id", "i").agg(F.min(F.least(*ends)).alias("lo"), F.max(F.greatest(*ends)).alias("hi"))
    return rows.withColumn("j", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size)))).select("id", "i", "j")


def window_tiles(points: DataFrame, window: int, stride: int, columns: int, rows: int) -> DataFrame:
    """(id, ti, tj): overlapping windows of ``window`` tiles placed every ``stride`` tiles that hold a point's tile."""
    span = lambda c, n: F.sequence(F.greatest(F.ceil((F.col(c) - window + 1) / stride), F.lit(0)), F.least(F.floor(F.col(c) / stride), F.lit(n - 1)))
    ok = points.filter((F.floor(F.col("i") / stride) >= 0) & (F.floor(F.col("j") / stride) >= 0))
    some = lambda a: F.when(F.get(a, F.lit(0)) <= F.get(a, F.size(a) - 1), a)
    return ok.withColumn("ti", F.explode(some(span("i", columns)))).withColumn("tj", F.explode(some(span("j", rows)))).select("id", "ti", "tj")


def hit_test(polygons: DataFrame, clicks: DataFrame, cell: float) -> DataFrame:
    """(click, id): the polygon drawn last (largest id) that holds each click. Polygons: (id, vertices)."""
    v = F.col("vertices")
    box = polygons.select("id", "vertices", F.array_min(F.transform(v, lambda p: p["x"])).alias("x"), F.array_min(F.transform(v, lambda p: p["y"])).alias("y"), F.array_max(F.transform(v, lambda p: p["x"])).alias("x2"), F.array_max(F.transform(v, lambda p: p["y"])).alias("y2"))
    boxed = _cells(box.withColumn("w", F.col("x2") - F.col("x")).withColumn("h", F.col("y2") - F.col("y")), cell, ("x", "y", "w", "h")).select("id", "vertices", "cx", "cy")
    c = clicks.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    return c.join(boxed, ["cx", "cy"]).filter(g.contains(F.col("vertices"), F.col("px"), F.col("py"))).groupBy("click").agg(F.max("id").alias("id"))


def align_order(layers: DataFrame, most: int = 4) -> DataFrame:
    """For each layer, up to ``most`` layers of another magnification, nearest scale first: (id, id2, turn)."""
    o = layers.select(F.col("slide"), F.col("id").alias("id2"), F.col("scale").alias("s2"), F.col("mag").alias("m2"))
    j = layers.join(o, "slide").filter("id <> id2 and mag <> m2")
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.abs(F.log("scale") - F.log("s2")), "id2"))
    return j.withColumn("turn", turn).filter(F.col("turn") <= most).select("id", "id2", "turn")
