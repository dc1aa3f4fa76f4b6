"""Spatial queries over boxes made from ``part`` and grids made from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import geometry as g
from lumenfold.functions import magnification as mag
from lumenfold.operators import spatial as s

from .registry import query, table

_BOX = "b AS (SELECT p_partkey AS id, p_brand AS brand, (p_partkey * 37 % 5000)::DOUBLE AS x, (p_partkey * 91 % 5000)::DOUBLE AS y, (p_size * 4 + 20)::DOUBLE AS w, (p_size * 3 + 30)::DOUBLE AS h FROM part)"


def boxes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("id"), F.col("p_brand").alias("brand"), (k * 37 % 5000).cast("double").alias("x"), (k * 91 % 5000).cast("double").alias("y"), (F.col("p_size") * 4 + 20).cast("double").alias("w"), (F.col("p_size") * 3 + 30).cast("double").alias("h"))


_MEET = "a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h"
_W, _H = "(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))", "(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(f"""WITH {_BOX} SELECT a.id AS a_id, b.id AS b_id, round(CASE WHEN a.brand = b.brand THEN 1.0 ELSE ({_W} ** 2 + {_H} ** 2) / (a.w ** 2 + a.h ** 2) END, 6) AS diag_ratio,
 round({_W} * {_H} / (a.w * a.h), 6) AS area_ratio FROM b a JOIN b ON a.id < b.id AND {_MEET}""")
def bbox_overlap(spark, sf_dir):
    b = boxes(spark, sf_dir)
    out = s.overlap_scores(s.overlap_classes(b, b, 256.0, keep=["brand"]), F.col("a_brand") == F.col("b_brand"))
    out = out.select("a_ids", "b_ids", F.round("diag_ratio", 6).alias("diag_ratio"), F.round("area_ratio", 6).alias("area_ratio"))
    return s.expand_classes(out).filter("a_id < b_id").select("a_id", "b_id", "diag_ratio", "area_ratio")


@query(f"WITH {_BOX} SELECT a.id AS a_id, b.id AS b_id FROM b a JOIN b ON a.brand <> b.brand AND a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
def frames_overlap(spark, sf_dir):
    b = boxes(spark, sf_dir)
    pairs = s.overlap_classes(b, b, 256.0, closed=False, keep=["brand"]).filter("a_brand <> b_brand").select("a_ids", "b_ids")
    return s.expand_classes(pairs).filter("a_id < b_id").select("a_id", "b_id")


@query(f"WITH {_BOX} SELECT a.brand, a.id, b.id AS id2 FROM b a JOIN b ON a.brand = b.brand AND a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < {int(0.7 * 300 ** 2)}")
def member_overlap_round(spark, sf_dir):
    return s.member_overlaps(boxes(spark, sf_dir), "brand", 300.0, True)


@query(f"WITH {_BOX} SELECT a.brand, a.id, b.id AS id2 FROM b a JOIN b ON a.brand = b.brand AND a.id < b.id AND abs(a.x - b.x) < 225 AND abs(a.y - b.y) < 225")
def member_overlap_box(spark, sf_dir):
    return s.member_overlaps(boxes(spark, sf_dir), "brand", 0.0, False, crop=0.5, size=500.0)


@query(f"WITH {_BOX} SELECT brand, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM b GROUP BY brand")
def bbox_union(spark, sf_dir):
    return s.union_box(boxes(spark, sf_dir), ["brand"])


@query(f"WITH {_BOX} SELECT id, x - min(x) OVER (PARTITION BY brand) AS x, y - min(y) OVER (PARTITION BY brand) AS y FROM b")
def bbox_to_origin(spark, sf_dir):
    return s.to_origin(boxes(spark, sf_dir), ["brand"]).select("id", "x", "y")


_TILES = "t AS (SELECT *, unnest(range(floor(x / 64)::BIGINT, greatest(ceil((x + w) / 64)::BIGINT - 1, floor(x / 64)::BIGINT) + 1)) AS i FROM b), u AS (SELECT *, unnest(range(floor(y / 64)::BIGINT, greatest(ceil((y + h) / 64)::BIGINT - 1, floor(y / 64)::BIGINT) + 1)) AS j FROM t)"


@query(f"WITH {_BOX}, {_TILES} SELECT id, i, j, i * 64 >= x AND j * 64 >= y AND (i + 1) * 64 <= x + w AND (j + 1) * 64 <= y + h AS \"full\" FROM u")
def tile_coverage_rect(spark, sf_dir):
    return s.covered_tiles(boxes(spark, sf_dir), 64)


@query(f"""WITH {_BOX}, {_TILES}, c AS (SELECT *, list_sum([CASE WHEN (px - x - w / 2) ** 2 + (py - y - h / 2) ** 2 <= least(w, h) ** 2 / 4 THEN 1 ELSE 0 END for px in [i * 64, (i + 1) * 64]]) AS n0 FROM (SELECT u.*, unnest([j * 64, (j + 1) * 64]) AS py FROM u)),
k AS (SELECT id, i, j, sum(n0) AS n FROM c GROUP BY ALL) SELECT id, i, j, n = 4 AS "full" FROM k WHERE n > 0""")
def tile_coverage_circle(spark, sf_dir):
    return s.covered_tiles(boxes(spark, sf_dir), 64, round_view=True)


_POINTS = "p AS (SELECT vec_id AS id, floor(embedding[1] * 4000 + 2000)::DOUBLE AS x, floor(embedding[2] * 4000 + 2000)::DOUBLE AS y, label <> 3 AS active FROM embeddings), q AS (SELECT p_partkey AS q, (p_partkey * 37 % 4000)::DOUBLE AS x, (p_partkey * 91 % 4000)::DOUBLE AS y, 300.0 AS w, 200.0 AS h FROM part)"


def grid_inputs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.floor(F.element_at("embedding", i) * F.lit(4000).cast("float") + F.lit(2000).cast("float")).cast("double")
    p = e.select(F.col("vec_id").alias("id"), at(1).alias("x"), at(2).alias("y"), (F.col("label") != 3).alias("active"))
    k = F.col("p_partkey")
    q = table(spark, sf_dir, "part").select(k.alias("q"), (k * 37 % 4000).cast("double").alias("x"), (k * 91 % 4000).cast("double").alias("y"), F.lit(300.0).alias("w"), F.lit(200.0).alias("h"))
    return p, q


@query(f"WITH {_POINTS} SELECT q, id FROM q JOIN p ON p.active AND floor(p.x / 256) BETWEEN floor(q.x / 256) AND floor((q.x + w) / 256) AND floor(p.y / 256) BETWEEN floor(q.y / 256) AND floor((q.y + h) / 256)")
def grid_range(spark, sf_dir):
    return s.grid_query(*grid_inputs(spark, sf_dir))


@query(f"WITH {_POINTS} SELECT q, id FROM q JOIN p ON p.active AND p.x BETWEEN q.x AND q.x + w AND p.y BETWEEN q.y AND q.y + h")
def grid_range_exact(spark, sf_dir):
    return s.grid_query(*grid_inputs(spark, sf_dir), refine=True)


_BASE = "t0 AS (SELECT DISTINCT l_linenumber AS component, (l_partkey % 90 - 30)::INT AS i, (l_suppkey % 70 - 20)::INT AS j FROM lineitem)"


def base_tiles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linenumber").alias("component"), (F.col("l_partkey") % 90 - 30).cast("int").alias("i"), (F.col("l_suppkey") % 70 - 20).cast("int").alias("j")).distinct()


_UP = "t{n} AS (SELECT component, floor(i / 2)::INT AS i, floor(j / 2)::INT AS j, count(*) AS children FROM t{m} GROUP BY 1, 2, 3)"
_PYRAMID = f"{_BASE}, {_UP.format(n=1, m=0)}, {_UP.format(n=2, m=1)}, p AS (SELECT component, 0 AS level, i, j, 0::BIGINT AS children FROM t0 UNION ALL SELECT component, 1, i, j, children FROM t1 UNION ALL SELECT component, 2, i, j, children FROM t2)"


@query(f"WITH {_PYRAMID} SELECT * FROM p")
def pyramid_parent(spark, sf_dir):
    return s.pyramid(base_tiles(spark, sf_dir), 3)


@query(f"WITH {_PYRAMID} SELECT * FROM p WHERE level = 1 AND i BETWEEN 2 AND 9 AND j BETWEEN 0 AND 5")
def viewport_tiles(spark, sf_dir):
    return s.viewport_tiles(s.pyramid(base_tiles(spark, sf_dir), 3), 1024.0, 100.0, 3900.0, 2900.0, 2.0, 3)


@query("SELECT s_suppkey, round(0.5 * ((s_acctbal) + n_nationkey), 6) AS base, round((0.5 * (s_acctbal + n_nationkey)) / 0.5 - n_nationkey, 4) AS back, floor(s_acctbal / 256)::INT AS tile, trunc(s_acctbal / 256)::INT - CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS tile_ref FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def transform_roundtrip(spark, sf_dir):
    j = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    half, off = F.lit(0.5), F.col("n_nationkey")
    base = g.to_base(F.col("s_acctbal"), off, half)
    return j.select("s_suppkey", F.round(base, 6).alias("base"), F.round(g.from_base(base, off, half), 4).alias("back"), g.tile_index(F.col("s_acctbal")).alias("tile"), g.tile_index_ref(F.col("s_acctbal")).alias("tile_ref"))


@query("SELECT p_partkey, arg_min(l, abs(p_size / 50.0 - r) * 1000000 + p) AS label FROM part, (VALUES (1.0, 2, '2x'), (0.5, 4, '4x'), (0.2, 10, '10x'), (0.1, 20, '20x'), (0.05, 40, '40x')) v(r, p, l) GROUP BY 1")
def nearest_magnification(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", mag.nearest_label((F.col("p_size") / 50.0)).alias("label"))


@query(f"WITH {_BOX} SELECT id, w * h AS box, round(w * h - 4 * 12.5 * 12.5 / 2, 6) AS octagon FROM b")
def shoelace_area(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    r = F.lit(25.0)  # each corner loses a right triangle with sides of 12.5
    box, octagon = g.footprint(x, y, w, h, F.lit(False), r), g.footprint(x, y, w, h, F.lit(True), r)
    return boxes(spark, sf_dir).select("id", g.area(box).alias("box"), F.round(g.area(octagon), 6).alias("octagon"))


@query(f"WITH {_BOX} SELECT id, 8 AS corners, x + 25 AS x1, y AS y1, x AS x8, y + 25 AS y8 FROM b")
def footprint(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    f = boxes(spark, sf_dir).select("id", g.footprint(x, y, w, h, F.lit(True), F.lit(50.0)).alias("f"))
    return f.select("id", F.size("f").alias("corners"), F.element_at("f", 1)["x"].alias("x1"), F.element_at("f", 1)["y"].alias("y1"), F.element_at("f", 8)["x"].alias("x8"), F.element_at("f", 8)["y"].alias("y8"))


@query(f"WITH {_BOX}, c AS (SELECT s_suppkey AS click, (s_suppkey * 53 % 5000 + 0.5) AS px, (s_suppkey * 17 % 5000 + 0.5) AS py FROM supplier) SELECT click, max(id) AS id FROM c JOIN b ON px > x AND px < x + w AND py > y AND py < y + h GROUP BY click")
def click_hit(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    polygons = boxes(spark, sf_dir).select("id", g.footprint(x, y, w, h, F.lit(False), F.lit(0.0)).alias("vertices"))
    k = F.col("s_suppkey")
    clicks = table(spark, sf_dir, "supplier").select(k.alias("click"), (k * 53 % 5000 + 0.5).cast("double").alias("px"), (k * 17 % 5000 + 0.5).cast("double").alias("py"))
    return s.hit_test(polygons, clicks, 256.0)


@query(f"WITH {_BOX}, c AS (SELECT id, y, h, unnest(range(floor(x / 64)::BIGINT, floor((x + w) / 64)::BIGINT + 1)) AS i FROM b) SELECT id, i, unnest(range(floor(y / 64)::BIGINT, floor((y + h) / 64)::BIGINT + 1)) AS j FROM c")
def polygon_tiles(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    return s.polygon_tiles(boxes(spark, sf_dir).select("id", g.footprint(x, y, w, h, F.lit(False), F.lit(0.0)).alias("vertices")), 64)


@query("""WITH p AS (SELECT DISTINCT l_partkey % 40 AS i, l_suppkey % 30 AS j FROM lineitem), q AS (SELECT i * 100 + j AS id, i, j FROM p)
SELECT id, ti, tj FROM q JOIN (SELECT unnest(range(0, 20)) AS ti) ON i BETWEEN ti * 2 AND ti * 2 + 3 JOIN (SELECT unnest(range(0, 15)) AS tj) ON j BETWEEN tj * 2 AND tj * 2 + 3""")
def window_cover(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("i"), (F.col("l_suppkey") % 30).alias("j")).distinct().withColumn("id", F.col("i") * 100 + F.col("j"))
    return s.window_tiles(p, 4, 2, 20, 15)


@query("""WITH l AS (SELECT s_suppkey AS id, s_nationkey AS slide, (s_suppkey % 7 + 1)::DOUBLE AS scale, s_suppkey % 3 AS mag FROM supplier)
SELECT id, id2, turn::INT AS turn FROM (SELECT a.id, b.id AS id2, row_number() OVER (PARTITION BY a.id ORDER BY abs(ln(a.scale) - ln(b.scale)), b.id) AS turn FROM l a JOIN l b ON a.slide = b.slide AND a.id <> b.id AND a.mag <> b.mag) WHERE turn <= 4""")
def align_order(spark, sf_dir):
    k = F.col("s_suppkey")
    layers = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("slide"), (k % 7 + 1).cast("double").alias("scale"), (k % 3).alias("mag"))
    return s.align_order(layers)


@query(f"WITH {_BOX} SELECT a.id AS a_id, b.id AS b_id, greatest({_W}, 0) * greatest({_H}, 0) AS shared FROM b a JOIN b ON a.id + 1 = b.id")
def overlap_area(spark, sf_dir):
    b = boxes(spark, sf_dir)
    n = b.select((F.col("id") - 1).alias("id"), F.col("id").alias("b_id"), *[F.col(c).alias("b" + c) for c in "xywh"])
    j = b.join(n, "id")
    return j.select(F.col("id").alias("a_id"), "b_id", g.overlap_area(*[F.col(c) for c in ("x", "y", "w", "h", "bx", "by", "bw", "bh")]).alias("shared"))
