"""Queries over frames, components and layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import frames as f

from .registry import query, table
from .spatial import _BOX, boxes


def lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


_EDGES = "e AS (SELECT DISTINCT l_partkey % 300 AS src, l_suppkey % 300 + 1 AS dst, l_linenumber::DOUBLE AS t_x, (l_linenumber * 2)::DOUBLE AS t_y FROM lineitem)"


def edges(spark, sf_dir):
    return lineitem(spark, sf_dir).select((F.col("l_partkey") % 300).alias("src"), (F.col("l_suppkey") % 300 + 1).alias("dst"), F.col("l_linenumber").cast("double").alias("t_x"), (F.col("l_linenumber") * 2).cast("double").alias("t_y")).distinct()


@query(f"WITH {_EDGES} SELECT src, dst, t_x, src % 7 AS src_component, dst % 7 AS dst_component, src % 7 <> dst % 7 AS inter FROM e")
def match_split(spark, sf_dir):
    members = spark.range(301).select(F.col("id").alias("frame"), (F.col("id") % 7).alias("component"))
    return f.split_matches(edges(spark, sf_dir), members).select("src", "dst", "t_x", "src_component", "dst_component", "inter")


@query(f"WITH {_BOX}, n AS (SELECT brand, arg_max(id, id) AS newest FROM b GROUP BY 1) SELECT b.brand, b.id, newest FROM b JOIN n USING (brand) JOIN b m ON m.id = newest WHERE b.id <> newest AND b.x < m.x + m.w AND m.x < b.x + b.w AND b.y < m.y + m.h AND m.y < b.y + b.h")
def newest_overlaps(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("x", F.col("x")).withColumn("o", F.col("id"))
    return f.newest_overlaps(b, "brand", "o")


@query(f"WITH {_EDGES} SELECT src, dst, t_x - (src * 3 - dst * 3) AS rx, t_y - (src * 5 - dst * 5) AS ry FROM e")
def match_residuals(spark, sf_dir):
    p = spark.range(302).select(F.col("id").alias("frame"), (F.col("id") * 3.0).alias("x"), (F.col("id") * 5.0).alias("y"))
    return f.residuals(edges(spark, sf_dir), p)


@query("SELECT l_suppkey AS frame, count(*) FILTER (l_returnflag <> 'R') AS live FROM lineitem GROUP BY 1")
def live_features(spark, sf_dir):
    return f.count_live(lineitem(spark, sf_dir).select(F.col("l_suppkey").alias("frame"), (F.col("l_returnflag") != "R").alias("live")))


@query("SELECT p_partkey AS id, x::INT AS x, unnest(range(0, p_size * 2 - 40 + 1, 20))::INT AS y FROM (SELECT *, unnest(range(0, p_size * 3 - 40 + 1, 20)) AS x FROM part WHERE p_size * 3 >= 40) WHERE p_size * 2 >= 40")
def patch_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 3).alias("width"), (F.col("p_size") * 2).alias("height"))
    return f.patch_grid(p, 40, 20)


@query("SELECT l_orderkey AS frame, round(avg(l_quantity), 6) AS x, round(avg(l_tax), 6) AS y, count(*) AS n FROM lineitem GROUP BY 1")
def mean_hypothesis(spark, sf_dir):
    e = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("frame"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"))
    return f.mean_hypothesis(e).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query("""WITH RECURSIVE s AS (SELECT c_custkey % 600 AS component, count(*) AS size FROM customer GROUP BY 1), l AS (SELECT DISTINCT s_suppkey % 600 AS a, s_nationkey * 24 AS b FROM supplier),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b), r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a), g AS (SELECT node, min(other) AS grp FROM r GROUP BY 1),
j AS (SELECT component, size, coalesce(grp, component) AS grp FROM s LEFT JOIN g ON component = node), h AS (SELECT grp, component AS head, row_number() OVER (PARTITION BY grp ORDER BY component = 0 DESC, size DESC, component) AS k FROM j)
SELECT component, head AS "into" FROM j JOIN h USING (grp) WHERE k = 1""")
def component_priority(spark, sf_dir):
    sizes = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 600).alias("component")).agg(F.count("*").alias("size"))
    links = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 600).alias("a"), (F.col("s_nationkey") * 24).cast("long").alias("b")).distinct()
    return f.absorb_with_priority(sizes, links)


@query("""WITH RECURSIVE n AS (SELECT o_custkey % 900 AS a, o_orderkey % 900 AS b FROM orders GROUP BY ALL), e AS (SELECT a, b FROM n UNION SELECT b, a FROM n),
w AS (SELECT 5::BIGINT AS node, 5::BIGINT AS seed, 0 AS steps UNION SELECT 17, 17, 0 UNION SELECT e.b, w.seed, w.steps + 1 FROM w JOIN e ON e.a = w.node WHERE w.steps < 8)
SELECT node, seed, steps FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY steps, seed) AS k FROM w) WHERE k = 1""")
def membership_spread(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 900).alias("src"), (F.col("o_orderkey") % 900).alias("dst")).distinct()
    return f.spread(e, spark.createDataFrame([(5,), (17,)], "node long"))


@query("""WITH RECURSIVE l AS (SELECT s_nationkey::BIGINT AS slide, s_suppkey AS id, s_suppkey % 3 AS mag, s_suppkey % 10 = 0 AS placed FROM supplier),
p AS (SELECT a.slide, a.id, b.id AS via FROM l a JOIN l b ON a.slide = b.slide AND a.mag <> b.mag AND abs(a.id - b.id) <= 60),
w AS (SELECT slide, id, 0 AS r FROM l WHERE placed UNION SELECT p.slide, p.id, w.r + 1 FROM w JOIN p ON p.slide = w.slide AND p.via = w.id WHERE w.r < 20),
f AS (SELECT slide, id, min(r) AS r FROM w GROUP BY ALL), t AS (SELECT f.slide, f.id, min(p.via) AS via FROM f JOIN p USING (slide, id) JOIN f g ON g.slide = f.slide AND g.id = p.via AND g.r = f.r - 1 GROUP BY ALL),
o AS (SELECT slide, id, 0.0::DOUBLE AS off, NULL::BIGINT AS via FROM l WHERE placed UNION ALL SELECT t.slide, t.id, o.off + (t.id - t.via) * 1.5, t.via::BIGINT FROM o JOIN t ON t.slide = o.slide AND t.via = o.id)
SELECT slide, id, off, via FROM o""")
def layer_alignment(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    layers = s.select(F.col("s_nationkey").cast("long").alias("slide"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("mag"), (F.col("s_suppkey") % 10 == 0).alias("placed"))
    o = layers.select("slide", F.col("id").alias("via"))
    pairs = layers.join(o, "slide").filter("abs(id - via) <= 60 and id <> via").select("slide", "id", "via", ((F.col("id") - F.col("via")) * 1.5).alias("off"))
    return f.align_layers(layers, pairs)


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag = 'R' THEN l_tax END, CASE WHEN l_linenumber > 2 THEN l_discount END, 0.5) AS scale, CASE WHEN l_returnflag = 'R' THEN 'features' WHEN l_linenumber > 2 THEN 'velocity' ELSE 'label' END AS how FROM lineitem")
def scale_anchor(spark, sf_dir):
    li = lineitem(spark, sf_dir)
    scale, how = f.anchor(F.when(F.col("l_returnflag") == "R", F.col("l_tax")), F.when(F.col("l_linenumber") > 2, F.col("l_discount")), F.lit(0.5))
    return li.select("l_orderkey", "l_linenumber", scale.alias("scale"), how.alias("how"))


@query(f"WITH {_BOX} SELECT brand AS component, id AS frame, round(x * 2 / (id % 4 + 1) - x, 6) AS off_x, round(y * 3 / (id % 4 + 1) - y, 6) AS off_y FROM b")
def landmark_offset(spark, sf_dir):
    b = boxes(spark, sf_dir).select(F.col("brand").alias("component"), F.col("id").alias("frame"), "x", "y", (F.col("id") % 4 + 1).alias("s"))
    marks = b.select("frame", (F.col("x") * 2).alias("bx"), (F.col("y") * 3).alias("by"))
    return f.landmark_offset(b, marks, "s").withColumn("off_x", F.round("off_x", 6)).withColumn("off_y", F.round("off_y", 6))


@query("""WITH v AS (SELECT vec_id AS frame, embedding, unnest(range(0, len(embedding) // 2)) AS kp FROM embeddings) SELECT frame, kp::INT AS kp, round(embedding[kp * 2 + 1]::DOUBLE / 0.25, 6) AS x, round(embedding[kp * 2 + 2]::DOUBLE / 0.25, 6) AS y, frame * 1024 + kp AS track FROM v""")
def keypoint_explode(spark, sf_dir):
    half = F.floor(F.size("embedding") / 2).cast("int")
    kps = F.transform(F.sequence(F.lit(0), half - 1), lambda k: F.struct(F.get("embedding", k * 2).cast("double").alias("x"), F.get("embedding", k * 2 + 1).cast("double").alias("y")))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.when(half > 0, kps).alias("kps"))
    return f.explode_keypoints(e, 0.25).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query(f"WITH {_BOX} SELECT id AS track, CASE WHEN id % 5 < 2 THEN 9 ELSE id % 5 END AS comp, x + CASE id % 5 WHEN 0 THEN 3.5 WHEN 1 THEN -2 ELSE 0 END AS x, y + CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 0 END AS y FROM b")
def track_translate(spark, sf_dir):
    t = boxes(spark, sf_dir).select(F.col("id").alias("track"), (F.col("id") % 5).alias("comp"), "x", "y")
    s = spark.createDataFrame([(0, 9, 3.5, 1.0), (1, 9, -2.0, 4.0)], "comp long, into long, t_x double, t_y double")
    return f.translate_tracks(t, s, "comp")


@query("WITH k AS (SELECT l_suppkey, l_partkey % 50 AS p, min(l_orderkey * 10 + l_linenumber) AS a FROM lineitem GROUP BY ALL) SELECT l_suppkey, p, row_number() OVER (ORDER BY a, l_suppkey, p) - 1 AS id FROM k")
def dense_ids(spark, sf_dir):
    li = lineitem(spark, sf_dir).select("l_suppkey", (F.col("l_partkey") % 50).alias("p"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return f.dense_ids(li, ["l_suppkey", "p"], "o")


@query("SELECT c_nationkey AS slide, c_custkey AS q, e.event_id AS frame FROM customer JOIN events e ON e.event_id BETWEEN c_custkey % 2000 AND c_custkey % 2000 + c_custkey % 5 WHERE e.user_id % 25 = c_nationkey")
def interval_frames(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("slide"), F.col("c_custkey").alias("q"), (F.col("c_custkey") % 2000).alias("first"), (F.col("c_custkey") % 2000 + F.col("c_custkey") % 5).alias("last"))
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("slide"), F.col("event_id").alias("frame"))
    return f.frames_of_interval(c, e, "slide").withColumn("slide", F.col("slide").cast("int"))


@query("SELECT DISTINCT l_partkey % 40 AS i, l_suppkey % 30 AS j, (l_suppkey % 30 // 2) * 20 + l_partkey % 40 // 2 AS tile FROM lineitem")
def model_tile(spark, sf_dir):
    t = lineitem(spark, sf_dir).select((F.col("l_partkey") % 40).alias("i"), (F.col("l_suppkey") % 30).alias("j")).distinct()
    return t.withColumn("tile", f.model_tile(F.col("i"), F.col("j"), 2, 20))


@query("SELECT DISTINCT l_linenumber AS component, l_suppkey AS frame FROM lineitem")
def vertex_owners(spark, sf_dir):
    o = lineitem(spark, sf_dir).select(F.col("l_linenumber").alias("component"), (F.col("l_partkey") % 40).alias("vertex"), F.col("l_suppkey").alias("frame"))
    return f.owned_vertices(o.select("component", "vertex").distinct(), o)


@query("""WITH c AS (SELECT s_suppkey AS component, (s_suppkey % 4)::VARCHAR AS label, s_suppkey % 9 = 0 AS suspended FROM supplier), f AS (SELECT c_custkey AS frame, (c_custkey % 5)::VARCHAR AS label, c_custkey % 20 AS component FROM customer)
SELECT frame, c.component AS target FROM f JOIN c USING (label) WHERE NOT suspended AND c.component <> f.component""")
def cross_component_search(spark, sf_dir):
    k = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier").select(k.alias("component"), (k % 4).cast("string").alias("label"), (k % 9 == 0).alias("suspended"))
    k = F.col("c_custkey")
    fr = table(spark, sf_dir, "customer").select(k.alias("frame"), (k % 5).cast("string").alias("label"), (k % 20).alias("component"))
    return f.cross_component_pairs(fr, c)


@query("""WITH c AS (SELECT p_partkey AS frame, p_size * 9 AS a, p_size * 14 AS b FROM part), u AS (SELECT frame, CASE WHEN a >= 250 THEN 'first' ELSE 'fallback' END AS used, CASE WHEN a >= 250 THEN a ELSE b END AS n FROM c)
SELECT *, CASE WHEN n < 250 THEN 'low_features' ELSE 'good' END AS quality FROM u""")
def feature_cascade(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("frame"), (F.col("p_size") * 9).alias("n_first"), (F.col("p_size") * 14).alias("n_fallback"))
    return f.feature_cascade(p)


@query("SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 16 AS batch FROM part")
def tile_batches(spark, sf_dir):
    return f.tile_batches(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"], 16).select("p_partkey", "batch")


@query("WITH n AS (SELECT l_returnflag, l_suppkey, count(*) AS size FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_suppkey, size FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY size DESC, l_suppkey) AS k FROM n) WHERE k = 1")
def largest_island(spark, sf_dir):
    return f.largest_group(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey")


@query("SELECT l_partkey AS track, round(avg(l_suppkey * 2.0 + l_quantity), 6) AS x, round(avg(l_suppkey * 3.0 + l_linenumber), 6) AS y, count(*) AS n FROM lineitem GROUP BY 1")
def track_positions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    o = li.select(F.col("l_partkey").alias("track"), F.col("l_suppkey").alias("frame"), F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("y"))
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"), (F.col("s_suppkey") * 2.0).alias("x"), (F.col("s_suppkey") * 3.0).alias("y"))
    return f.track_positions(o, p).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query()
def track_refusal(spark, sf_dir):
    """Tracks over the mutual matches, merged strongest first without conflicts: one group a closure of matches,
    as merges in one closure don't touch another."""
    from lumenfold.operators import graph

    from .matching import mutual

    m = mutual(spark, sf_dir)
    closure = graph.tracks(m).select(F.col("frame").alias("src"), F.col("kp").alias("src_kp"), F.col("track").alias("grp"))
    return f.refusing_tracks(m.join(closure, ["src", "src_kp"]), "grp")


@query("SELECT p_partkey, CASE WHEN p_partkey BETWEEN 0 AND 99 THEN '2x' WHEN p_partkey BETWEEN 100 AND 499 THEN '10x' WHEN p_partkey BETWEEN 450 AND 1200 THEN '40x' END AS label FROM part")
def label_by_range(spark, sf_dir):
    from lumenfold.functions import magnification as mag

    return table(spark, sf_dir, "part").select("p_partkey", mag.label_by_range(F.col("p_partkey"), [(0, 99, "2x"), (100, 499, "10x"), (450, 1200, "40x")]).alias("label"))
