"""Matching and voting queries over stand-in frames: an embedding is a keypoint, its image is vec_id % 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import matching as m
from lumenfold.operators import voting

from .registry import query, table

_KP = """
k AS (SELECT vec_id AS kp, vec_id % 10 AS frame,
  CAST(CASE WHEN embedding[1] > 0 THEN -9223372036854775808 ELSE 0 END + list_sum(list_transform(range(2, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (64 - i)::INT) ELSE 0::BIGINT END)) AS BIGINT) AS dsc FROM embeddings),
near AS (SELECT a.frame AS src, b.frame AS dst, a.kp AS q, b.kp AS t, bit_count(xor(a.dsc, b.dsc))::DOUBLE AS d FROM k a JOIN k b ON a.frame < b.frame),
fwd AS (SELECT *, row_number() OVER (PARTITION BY src, dst, q ORDER BY d, t) AS r FROM near),
bwd AS (SELECT *, row_number() OVER (PARTITION BY src, dst, t ORDER BY d, q) AS r FROM near),
f2 AS (SELECT src, dst, q, max(t) FILTER (r = 1) AS t1, max(d) FILTER (r = 1) AS d1, max(t) FILTER (r = 2) AS t2, max(d) FILTER (r = 2) AS d2 FROM fwd WHERE r <= 2 GROUP BY ALL HAVING count(*) = 2),
b2 AS (SELECT src, dst, t, max(q) FILTER (r = 1) AS q1, max(d) FILTER (r = 1) AS d1, max(d) FILTER (r = 2) AS d2 FROM bwd WHERE r <= 2 GROUP BY ALL HAVING count(*) = 2)
"""
_MUTUAL = "mutual AS (SELECT f2.src, f2.dst, f2.q AS src_kp, f2.t1 AS dst_kp, f2.d1 AS dist FROM f2 JOIN b2 ON f2.src = b2.src AND f2.dst = b2.dst AND f2.t1 = b2.t AND b2.q1 = f2.q WHERE f2.d1 < {r} * f2.d2 AND b2.d1 < {r} * b2.d2)"
RATIO = 0.85


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 10).alias("frame"), F.col("vec_id").alias("kp"), m.pack_signs("embedding").alias("desc"))


def pairs(spark: SparkSession) -> DataFrame:
    return m.frame_pairs(spark.range(10).toDF("frame"), window=9)


def mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mutual_matches(keypoints(spark, sf_dir), pairs(spark), RATIO)


@query(f"WITH {_KP}, {_MUTUAL.format(r=RATIO)} SELECT * FROM mutual")
def match_mutual_ratio(spark, sf_dir):
    return mutual(spark, sf_dir)


@query(f"WITH {_KP} SELECT src, dst, q, t1, d1, t2, d2 FROM f2")
def match_knn2(spark, sf_dir):
    return m.knn2(keypoints(spark, sf_dir), pairs(spark))


@query(f"WITH {_KP} SELECT src, dst, q, t1, d1, t2, d2 FROM f2 WHERE d1 < 0.75 * d2")
def match_ratio_oneway(spark, sf_dir):
    return m.ratio_matches(m.knn2(keypoints(spark, sf_dir), pairs(spark)))


@query("""
WITH k AS (SELECT vec_id AS kp, vec_id % 10 AS frame, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.frame AS src, b.frame AS dst, a.kp AS q, b.kp AS t, list_distance(a.v, b.v) AS d FROM k a JOIN k b ON a.frame < b.frame),
f AS (SELECT src, dst, q, arg_min(t, d) AS t1, min(d, 2) AS dd FROM near GROUP BY ALL),
b AS (SELECT src, dst, t, arg_min(q, d) AS q1, min(d, 2) AS dd FROM near GROUP BY ALL)
SELECT f.src, f.dst, f.q AS src_kp, f.t1 AS dst_kp, round(f.dd[1], 6) AS dist FROM f JOIN b ON f.src = b.src AND f.dst = b.dst AND f.t1 = b.t AND b.q1 = f.q
WHERE f.dd[1] < 0.95 * f.dd[2] AND b.dd[1] < 0.95 * b.dd[2]
""")
def match_l2_mutual(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("frame"), F.col("vec_id").alias("kp"), F.col("embedding").cast("array<double>").alias("desc"))
    return m.mutual_matches(e, pairs(spark), 0.95).withColumn("dist", F.round("dist", 6))


@query(f"""WITH {_KP}, {_MUTUAL.format(r=RATIO)}, e AS (SELECT src, dst, count(*) AS inliers FROM mutual GROUP BY ALL),
c AS (SELECT *, CAST(sum(inliers) OVER (PARTITION BY dst ORDER BY src DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gathered FROM e),
p AS (SELECT * FROM c WHERE gathered - inliers <= 5)
SELECT src, dst, inliers, gathered, max(gathered) OVER (PARTITION BY dst) > 3 AS ok FROM p""")
def match_backward_quorum(spark, sf_dir):
    return m.backward_quorum(m.edge_counts(mutual(spark, sf_dir)), quorum=5, least=3)


@query(f"""WITH {_KP}, {_MUTUAL.format(r=RATIO)}, e AS (SELECT src, dst, count(*) AS inliers FROM mutual GROUP BY ALL)
SELECT src, dst, inliers, turn::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS turn FROM e) WHERE turn <= 4""")
def match_first_accepted(spark, sf_dir):
    return m.first_accepted(m.edge_counts(mutual(spark, sf_dir)))


@query("""WITH c AS (SELECT l_partkey % 50 AS src, l_suppkey % 50 AS dst, l_linenumber AS turn, sum(l_quantity::BIGINT)::BIGINT AS inliers FROM lineitem GROUP BY ALL)
SELECT src, dst, arg_max(turn, inliers * 100 - turn) AS turn, max(inliers) AS inliers FROM c GROUP BY src, dst""")
def match_best_scale(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = li.groupBy((F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 50).alias("dst"), F.col("l_linenumber").alias("turn")).agg(F.sum(F.col("l_quantity").cast("long")).alias("inliers"))
    return m.best_scale(c)


@query("""
WITH h AS (SELECT l_orderkey, l_linenumber, [1 + (l_tax - 0.04), l_discount - 0.05, 0, l_tax - 0.03, 1 + (l_discount - 0.05), 0, (l_linenumber - 3) * 0.0004, 0, 1]::DOUBLE[] AS h, l_quantity AS t_x, -l_quantity AS t_y FROM lineitem)
SELECT l_orderkey, l_linenumber FROM h WHERE abs(h[7]) <= 0.001 AND abs(h[8]) <= 0.001 AND abs(h[2]) <= 0.05 AND abs(h[4]) <= 0.05 AND abs(h[1] - h[5]) <= 0.05
 AND abs(h[1] - 1) <= 0.05 AND abs(h[5] - 1) <= 0.05 AND abs(t_x) < 44 / 1.1 AND abs(t_y) < 44 / 1.1
""")
def match_geometry_gate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    zero = F.lit(0.0)
    h = F.array(1 + (F.col("l_tax") - 0.04), F.col("l_discount") - 0.05, zero, F.col("l_tax") - 0.03, 1 + (F.col("l_discount") - 0.05), zero, (F.col("l_linenumber") - 3) * F.lit(0.0004), zero, F.lit(1.0))
    rows = li.select("l_orderkey", "l_linenumber", h.alias("h"), F.col("l_quantity").alias("t_x"), (-F.col("l_quantity")).alias("t_y"))
    return rows.filter(m.geometry_gate(width=44.0, height=44.0)).select("l_orderkey", "l_linenumber")


_VOTES = "v AS (SELECT o_custkey AS grp, o_orderkey AS vote_id, floor(o_totalprice / 1000) AS x, (epoch(o_orderdate) // 86400 % 400)::DOUBLE AS y, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10 AS inliers FROM orders)"


def votes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.unix_date(F.to_date("o_orderdate")) % 400
    return o.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("vote_id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("x"), day.cast("double").alias("y"), (F.substring("o_orderpriority", 1, 1).cast("long") * 10).alias("inliers"))


@query(f"""WITH {_VOTES}, n AS (SELECT a.grp, a.vote_id, a.x, a.y, a.inliers, count(*) AS n_near, sum(b.inliers)::BIGINT AS score FROM v a JOIN v b ON a.grp = b.grp AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 100 ** 2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (n_near >= 3) DESC, CASE WHEN n_near >= 3 THEN score END DESC NULLS LAST, inliers DESC, vote_id) AS r FROM n)
SELECT grp, vote_id, x, y, n_near, score, n_near >= 3 AS clustered FROM r WHERE r = 1""")
def vote_cluster_winner(spark, sf_dir):
    return voting.resolve_votes(votes(spark, sf_dir), radius=100.0)


@query(f"WITH {_VOTES} SELECT grp, sum(inliers)::BIGINT AS total FROM v GROUP BY grp HAVING sum(inliers) > 50")
def vote_threshold(spark, sf_dir):
    return voting.ready(votes(spark, sf_dir))


@query(f"""WITH {_VOTES}, w AS (SELECT grp, vote_id, CAST(trunc(x - (inliers / 7.0)) AS INT) AS abs_x, CAST(trunc(y - (inliers / 3.0)) AS INT) AS abs_y FROM v) SELECT * FROM w""")
def vote_positions(spark, sf_dir):
    v = votes(spark, sf_dir).withColumn("t_x", F.col("inliers") / 7.0).withColumn("t_y", F.col("inliers") / 3.0)
    x, y = voting.position_from("x", "y", "t_x", "t_y")
    return v.select("grp", "vote_id", x.alias("abs_x"), y.alias("abs_y"))


@query("""
WITH m AS (SELECT l_orderkey % 20 AS src, l_orderkey % 20 + 1 + l_suppkey % 3 AS dst, l_quantity * 2 AS dx, l_linenumber * 1.0 AS dy FROM lineitem),
n AS (SELECT a.src, a.dst, a.dx, a.dy, count(*) AS inliers, avg(b.dx) AS t_x, avg(b.dy) AS t_y FROM (SELECT DISTINCT * FROM m) a JOIN m b ON a.src = b.src AND a.dst = b.dst AND (a.dx - b.dx) ** 2 + (a.dy - b.dy) ** 2 <= 9 GROUP BY ALL)
SELECT src, dst, round(t_x, 6) AS t_x, round(t_y, 6) AS t_y, inliers FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY inliers DESC, dx, dy) AS r FROM n) WHERE r = 1
""")
def consensus_translation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select((F.col("l_orderkey") % 20).alias("src"), (F.col("l_orderkey") % 20 + 1 + F.col("l_suppkey") % 3).alias("dst"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("l_quantity") * 2).alias("x2"), F.col("l_linenumber").cast("double").alias("y2"))
    return m.consensus_translation(rows).withColumn("t_x", F.round("t_x", 6)).withColumn("t_y", F.round("t_y", 6))


@query("""SELECT l_suppkey AS src, l_suppkey + 1 AS dst, count(*) FILTER (l_linenumber <> 7) AS inliers, 1.01::DOUBLE AS h0, 0.02::DOUBLE AS h1, (l_suppkey % 40)::DOUBLE AS h2, (-0.01)::DOUBLE AS h3, 1.02::DOUBLE AS h4, 7::DOUBLE AS h5, true AS accepted
FROM lineitem GROUP BY l_suppkey""")
def homography_consensus(spark, sf_dir):
    """Correspondences under a known homography, those of line 7 far from it."""
    x, y, far = F.col("l_partkey") * 7 % 640, F.col("l_orderkey") * 11 % 480, F.when(F.col("l_linenumber") == 7, 200 + F.col("l_orderkey") % 300).otherwise(0)
    w = 1 + x * 1e-4 - y * 2e-4
    x2, y2 = (x * 1.01 + y * 0.02 + F.col("l_suppkey") % 40) / w, (x * -0.01 + y * 1.02 + 7) / w
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") + 1).alias("dst"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x2 + far).alias("x2"), (y2 + far).alias("y2"))
    h = m.consensus_homography(rows)
    gate = m.geometry_gate("h", "t_x", "t_y", 640, 480)
    h = h.withColumn("t_x", F.get("h", F.lit(2))).withColumn("t_y", F.get("h", F.lit(5))).withColumn("accepted", gate)
    return h.select("src", "dst", "inliers", *[F.round(F.get("h", F.lit(i)), 5).alias(f"h{i}") for i in range(6)], "accepted")


# --- frames of a hundred keypoints at two scales each; at each scale some keypoints are far from their place ---

_FAR = {"src": "(vec_id // 7 + level) % (3 + vec_id // 100 % 3) = 0", "dst": "(vec_id // 3 + 2 * level) % (4 + vec_id // 100 % 2) = 0"}


@query(f"""WITH s AS (SELECT vec_id, level, {_FAR["src"]} AS far FROM embeddings, range(2) l(level)), d AS (SELECT vec_id, level, {_FAR["dst"]} AS far FROM embeddings, range(2) l(level)),
t AS (SELECT vec_id // 100 AS src, s.level AS src_level, d.level AS dst_level, count(*) FILTER (NOT s.far AND NOT d.far) AS inliers FROM s JOIN d USING (vec_id) GROUP BY ALL HAVING inliers >= 4),
b AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY inliers DESC, src_level, dst_level) AS r FROM t)
SELECT src, src + 1000000000 AS dst, src_level, dst_level, inliers, 0.0::DOUBLE AS error, 1.01::DOUBLE AS h0, 0.02::DOUBLE AS h1, 5::DOUBLE AS h2, (-0.01)::DOUBLE AS h3, 0.99::DOUBLE AS h4, 7::DOUBLE AS h5 FROM b WHERE r = 1""")
def scale_pair_search(spark, sf_dir):
    """Each frame against itself under a known homography, over all pairs of scales."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 100).alias("frame"), "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("level"))
    x, y, shift = F.col("vec_id") * 37 % 640, F.col("vec_id") * 91 % 480, F.col("vec_id") * 13 % 200 + 100
    sides = {"src": (x, y, 0, 1, (1.0, 0.5)), "dst": (x * 1.01 + y * 0.02 + 5, x * -0.01 + y * 0.99 + 7, 1_000_000_000, -1, (0.5, 0.25))}

    def side(name):
        px, py, first, sign, scales = sides[name]
        far = F.when(F.expr(_FAR[name].replace("//", "div")), sign * shift).otherwise(0)
        scale = F.when(F.col("level") == 0, scales[0]).otherwise(scales[1])
        return e.select((F.col("frame") + first).alias("frame"), "level", scale.alias("scale"), F.col("vec_id").alias("kp"), ((px + far) * scale).alias("x"), ((py + far) * scale).alias("y"), F.col("embedding").alias("desc"))

    pairs = e.select(F.col("frame").alias("src"), (F.col("frame") + 1_000_000_000).alias("dst")).distinct()
    best = m.scale_pair_search(side("src").union(side("dst")), pairs)
    numbers = [F.round(F.get("h", F.lit(i)), 5).alias(f"h{i}") for i in range(6)]
    return best.select("src", "dst", "src_level", "dst_level", "inliers", F.round("error", 5).alias("error"), *numbers)
