"""Graph, track and solver queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.operators import graph, solve

from .matching import _KP, _MUTUAL, RATIO, mutual
from .registry import query, table

_TREE = "f AS (SELECT event_id AS frame, CASE WHEN event_type = 'error' THEN NULL ELSE lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS matched_to, event_id % 11 AS tx, event_id % 7 AS ty FROM events)"
_WALK = f"WITH RECURSIVE {_TREE}, w AS (SELECT frame, frame AS root, 0::BIGINT AS depth, -tx AS x, -ty AS y FROM f WHERE matched_to IS NULL UNION ALL SELECT f.frame, w.root, w.depth + 1, w.x - f.tx, w.y - f.ty FROM w JOIN f ON f.matched_to = w.frame)"


def tree(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    prev = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("event_id").alias("frame"), F.when(F.col("event_type") != "error", prev).alias("matched_to"), (F.col("event_id") % 11).alias("tx"), (F.col("event_id") % 7).alias("ty"))


@query(f"{_WALK} SELECT frame AS node, root, x, y FROM w")
def positions_tree(spark, sf_dir):
    f = tree(spark, sf_dir).withColumn("x", -F.col("tx")).withColumn("y", -F.col("ty"))
    return graph.tree_positions(f, ["x", "y"])


@query(f"{_WALK} SELECT frame AS node, root, depth FROM w")
def find_root(spark, sf_dir):
    return graph.forest(tree(spark, sf_dir))


@query(f"{_WALK}, r AS (SELECT root, row_number() OVER (ORDER BY root)::INT - 1 AS component FROM (SELECT DISTINCT root FROM w)) SELECT frame AS node, root, component FROM w JOIN r USING (root)")
def component_spawn(spark, sf_dir):
    return graph.spawn_components(tree(spark, sf_dir))


_CC = """, e AS (SELECT src_kp AS a, dst_kp AS b FROM mutual UNION SELECT dst_kp, src_kp FROM mutual), reach AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


@query(f"WITH RECURSIVE {_KP}, {_MUTUAL.format(r=RATIO)}{_CC} SELECT * FROM c")
def components(spark, sf_dir):
    return graph.connected_components(mutual(spark, sf_dir), "src_kp", "dst_kp")


@query(f"WITH RECURSIVE {_KP}, {_MUTUAL.format(r=RATIO)}{_CC} SELECT component, count(*) AS size FROM c GROUP BY 1")
def component_sizes(spark, sf_dir):
    return components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("size"))


@query(f"""WITH RECURSIVE {_KP}, {_MUTUAL.format(r=RATIO)}{_CC}, t AS (SELECT node AS kp, node % 10 AS frame, component FROM c), x AS (SELECT component, max(n) > 1 AS conflict FROM (SELECT component, frame, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1)
SELECT frame, kp, conflict FROM t JOIN x USING (component)""")
def track_conflicts(spark, sf_dir):
    return graph.tracks(mutual(spark, sf_dir)).select("frame", "kp", "conflict")


@query(f"""WITH RECURSIVE {_KP}, {_MUTUAL.format(r=RATIO)}{_CC}, t AS (SELECT node % 10 AS frame, component FROM c), x AS (SELECT component, count(*) AS n, count(DISTINCT frame) AS f FROM t GROUP BY 1)
SELECT n AS n_frames, count(*) AS tracks FROM x WHERE n = f AND n > 1 GROUP BY 1""")
def track_materialise(spark, sf_dir):
    return graph.materialise_tracks(graph.tracks(mutual(spark, sf_dir))).groupBy("n_frames").agg(F.count("*").alias("tracks"))


@query("""WITH RECURSIVE s AS (SELECT c_custkey % 600 AS component, count(*) AS size FROM customer GROUP BY 1), l AS (SELECT DISTINCT s_suppkey % 600 AS a, s_nationkey * 24 AS b FROM supplier),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b), r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a), g AS (SELECT node, min(other) AS grp FROM r GROUP BY 1),
j AS (SELECT component, size, coalesce(grp, component) AS grp FROM s LEFT JOIN g ON component = node), h AS (SELECT grp, component AS head, row_number() OVER (PARTITION BY grp ORDER BY size DESC, component) AS k FROM j)
SELECT component, head AS "into" FROM j JOIN h USING (grp) WHERE k = 1""")
def component_absorb(spark, sf_dir):
    sizes = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 600).alias("component")).agg(F.count("*").alias("size"))
    links = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 600).alias("a"), (F.col("s_nationkey") * 24).cast("long").alias("b")).distinct()
    return graph.absorb(sizes, links)


@query()
def bundle_adjust(spark, sf_dir):
    """Observed offsets of landmarks from frames, rounded to whole pixels; positions per component."""
    li = table(spark, sf_dir, "lineitem")
    frame, mark = F.col("l_suppkey"), F.col("l_partkey") % 200
    o = li.select((F.col("l_linenumber") % 3).cast("long").alias("component"), frame.alias("frame"), mark.alias("landmark"), (F.round(mark * 13.7) - F.round(frame * 7.3)).alias("dx"), (F.round(mark * 3.1) - F.round(frame * 2.9)).alias("dy"))
    out = solve.solve_components(o, 60)
    return out.withColumn("x", F.round("x", 2)).withColumn("y", F.round("y", 2))


@query()
def greedy_coverage(spark, sf_dir):
    """Four parts that cover most customers, per brand."""
    li, o, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    covers = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("item"), F.col("o_custkey").alias("element")).distinct()
    return graph.greedy_cover(covers, "brand")


@query()
def path_promotion(spark, sf_dir):
    """Cheapest bridge between the least and greatest frame of each component; members are frames few of whose edges are penalised."""
    li = table(spark, sf_dir, "lineitem")
    li = li.select(F.col("l_linenumber").alias("comp"), (F.col("l_partkey") % 400).alias("a"), (F.col("l_suppkey") * 37 % 400).alias("b"), F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0).alias("penalty"))
    e = li.groupBy("comp", "a", "b").agg(F.min("penalty").alias("penalty"))
    ends = e.groupBy("comp").agg(F.least(F.min("a"), F.min("b")).alias("s"), F.greatest(F.max("a"), F.max("b")).alias("g"))
    nodes = e.select("comp", F.explode(F.array("a", "b")).alias("node"), "penalty").groupBy("comp", "node").agg(F.avg("penalty").alias("penalty"))
    members = nodes.filter("penalty < 0.05").select("comp", "node")
    e = e.join(ends, "comp")
    return graph.bridge_path(e, members, "comp", "s", "g")


@query(f"""WITH {_KP}, {_MUTUAL.format(r=RATIO)} SELECT src, dst, (least(src, dst) << 32) + greatest(src, dst) AS edge, (src_kp * 1024) + dst_kp % 1024 AS feature, dist < 8 AS near FROM mutual""")
def key_packing(spark, sf_dir):
    from lumenfold.functions import geometry as g

    m = mutual(spark, sf_dir)
    return m.select("src", "dst", g.pack_edge(F.col("src"), F.col("dst")).alias("edge"), g.pack_feature(F.col("src_kp"), F.col("dst_kp") % 1024).alias("feature"), (F.col("dist") < 8).alias("near"))


