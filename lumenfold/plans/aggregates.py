"""Aggregation and tile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import aggregates as a
from lumenfold.operators import tiles as t

from .registry import query, table


def lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def rounded(df, *names, places=6):
    for n in names:
        df = df.withColumn(n, F.round(n, places))
    return df


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, max(n) AS n, arg_max(event_type, (n, -ascii(event_type), -ascii(substr(event_type, 2)))) AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM n) WHERE r = 1 GROUP BY user_id")
def label_plurality(spark, sf_dir):
    return a.plurality(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""WITH m AS (SELECT least(l_partkey % 30, l_suppkey % 30) AS lo, greatest(l_partkey % 30, l_suppkey % 30) AS hi, CASE WHEN l_partkey % 30 <= l_suppkey % 30 THEN 1 ELSE -1 END AS s, l_quantity, l_linenumber FROM lineitem)
SELECT lo, hi, round(avg(s * l_quantity), 6) AS t_x, round(avg(s * l_linenumber), 6) AS t_y, count(*) AS n FROM m GROUP BY lo, hi""")
def absorb_translation(spark, sf_dir):
    m = lineitem(spark, sf_dir).select((F.col("l_partkey") % 30).alias("a"), (F.col("l_suppkey") % 30).alias("b"), F.col("l_quantity").alias("t_x"), F.col("l_linenumber").alias("t_y"))
    return rounded(a.mean_translation(m), "t_x", "t_y")


@query("""SELECT l_suppkey AS frame, round(avg(CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F' THEN l_quantity - l_tax END), 6) AS x, round(avg(CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F' THEN l_linenumber - l_discount END), 6) AS y,
 count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') > 0 AS valid FROM lineitem GROUP BY 1""")
def estimated_position(spark, sf_dir):
    o = lineitem(spark, sf_dir).select(F.col("l_suppkey").alias("frame"), F.col("l_quantity").alias("track_x"), F.col("l_linenumber").alias("track_y"), F.col("l_tax").alias("obs_x"), F.col("l_discount").alias("obs_y"), (F.col("l_returnflag") != "R").alias("live"), (F.col("l_linestatus") == "F").alias("solved"))
    return rounded(a.estimated_position(o), "x", "y")


@query("SELECT depth, count(*) AS tracks FROM (SELECT l_partkey, count(*) AS depth FROM lineitem GROUP BY 1) GROUP BY 1")
def depth_histogram(spark, sf_dir):
    return a.depth_histogram(lineitem(spark, sf_dir), "l_partkey")


@query("SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, round(stddev_samp(l_quantity), 6) AS deviation FROM lineitem GROUP BY 1")
def welford(spark, sf_dir):
    return rounded(a.moments(lineitem(spark, sf_dir), ["l_returnflag"], "l_quantity"), "mean", "variance", "deviation")


@query("SELECT l_linenumber, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS r FROM lineitem GROUP BY 1")
def pearson(spark, sf_dir):
    return rounded(a.pearson(lineitem(spark, sf_dir), ["l_linenumber"], "l_quantity", "l_extendedprice"), "r")


@query("SELECT l_linenumber, round(CASE WHEN sum(l_quantity * l_quantity) > 0 THEN sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) ELSE 1 END, 4) AS scale FROM lineitem GROUP BY 1")
def scale_fit(spark, sf_dir):
    return rounded(a.scale_fit(lineitem(spark, sf_dir), ["l_linenumber"], "l_quantity", "l_extendedprice"), "scale", places=4)


@query("""WITH h AS (SELECT least(greatest(floor((l_extendedprice - 0) / 110000 * 256), 0), 255)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS al FROM h)
SELECT min(bin) AS bin FROM c WHERE cum >= 0.95 * al""")
def percentile_bin(spark, sf_dir):
    return a.percentile_bin(lineitem(spark, sf_dir), "l_extendedprice", 0.0, 110000.0, 0.95)


@query("SELECT event_id FROM events JOIN (SELECT event_type, avg(value) - stddev_samp(value) AS f FROM events GROUP BY 1) USING (event_type) WHERE value > f")
def blur_outlier(spark, sf_dir):
    return a.drop_blurred(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_id")


@query("SELECT event_id, place::INT AS place FROM (SELECT event_id, row_number() OVER (PARTITION BY floor(user_id / 8.0), floor(event_id / 512.0) ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 5")
def topk_per_cell(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("gx", F.col("user_id") * 64.0)
    return a.top_per_cell(e, 512.0, 5, "gx", "event_id", "value", "event_id").select("event_id", "place")


@query("""WITH e AS (SELECT l_returnflag AS grp, unnest([l_partkey % 50, l_suppkey % 50 + 50]) AS node, (l_tax - l_discount) AS r FROM lineitem), m AS (SELECT grp, node, avg(r * r) AS v FROM e GROUP BY ALL)
SELECT grp, node, round(v, 6) AS mean_residual FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v DESC, node) AS k FROM m) WHERE k = 1""")
def worst_unknown(spark, sf_dir):
    r = lineitem(spark, sf_dir).select(F.col("l_returnflag").alias("grp"), (F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50 + 50).alias("b"), (F.col("l_tax") - F.col("l_discount")).alias("r"))
    return rounded(a.worst_unknown(r, "grp"), "mean_residual")


@query("SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY round(abs(ln(p_size / 10.0)), 4), p_retailprice DESC, p_partkey)::INT AS turn FROM part")
def greatest_priority_sort(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", (F.col("p_size") / 10.0).cast("double").alias("scale"), "p_retailprice")
    return a.overlap_order(p, "p_brand", "scale", "p_retailprice").select("id", "turn")


@query("SELECT l_orderkey, l_linenumber, coalesce(l_extendedprice > max(l_extendedprice) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM lineitem")
def keep_larger(spark, sf_dir):
    return a.keep_larger(lineitem(spark, sf_dir), ["l_partkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "accepted")


@query("""WITH s AS (SELECT l_linenumber AS k, sum(l_quantity * (l_tax - 0.05)) / sum(l_quantity * l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT k, round(v, 9) AS slope, round(CASE WHEN v < 0 THEN sqrt(-2 * v) ELSE 0 END, 6) AS sigma FROM s""")
def radial_slope(spark, sf_dir):
    li = lineitem(spark, sf_dir).select(F.col("l_linenumber").alias("k"), "l_quantity", (F.col("l_tax") - 0.05).alias("lr"))
    return a.radial_slope(li, ["k"], "l_quantity", "lr").select("k", F.round("slope", 9).alias("slope"), F.round("sigma", 6).alias("sigma"))


@query("""SELECT k, dx, dy, score FROM (SELECT l_partkey AS k, l_linenumber * 2 AS dx, l_suppkey % 20 * 2 AS dy, l_quantity AS score, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_linenumber, l_suppkey % 20) AS r FROM lineitem) WHERE r = 1""")
def best_offset(spark, sf_dir):
    li = lineitem(spark, sf_dir).select(F.col("l_partkey").alias("k"), (F.col("l_linenumber") * 2).alias("dx"), (F.col("l_suppkey") % 20 * 2).alias("dy"), F.col("l_quantity").alias("score"))
    return a.best_offset(li, ["k"], "score", "dx", "dy")


@query("""WITH r AS (SELECT event_id, user_id, event_type = 'click' AS kind, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts, event_id) AS r FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r, kind) AS turn FROM r) SELECT event_id FROM t WHERE turn <= 10""")
def balanced_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("kind", F.col("event_type") == "click")
    return a.balanced_sample(e, "user_id", "kind", ["ts", "event_id"]).select("event_id")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 0 WHEN event_id % 5 = 0 THEN 1 ELSE 10 END AS priority FROM events")
def embed_priority(spark, sf_dir):
    return a.priority_order(table(spark, sf_dir, "events"), F.col("event_type") == "click", F.col("event_id") % 5 == 0).select("event_id", "priority")


_NODES = list(range(8))


@query("WITH e AS (SELECT DISTINCT l_partkey % 8 AS s, (l_partkey % 8 * 3 + l_linenumber % 2) % 8 AS d FROM lineitem), b AS (SELECT s, d FROM e UNION SELECT d, s FROM e) SELECT n.i::BIGINT AS node, " + ", ".join(f"max(CASE WHEN d = {n} THEN 1 ELSE 0 END) AS n{n}" for n in _NODES) + " FROM range(8) n(i) LEFT JOIN b ON b.s = n.i GROUP BY 1")
def match_graph_csv(spark, sf_dir):
    e = lineitem(spark, sf_dir).select((F.col("l_partkey") % 8).alias("src"), ((F.col("l_partkey") % 8 * 3 + F.col("l_linenumber") % 2) % 8).alias("dst"))
    return a.match_matrix(e, _NODES)


# --- tiles ----------------------------------------------------------------------------------------------

_CAND = "c AS (SELECT l_partkey AS tile, l_orderkey * 10 + l_linenumber AS frame, l_quantity * 4 AS motion, l_extendedprice / 10 AS focus, (l_suppkey % 60)::DOUBLE AS d2 FROM lineitem)"


def candidates(spark, sf_dir):
    return lineitem(spark, sf_dir).select(F.col("l_partkey").alias("tile"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame"), (F.col("l_quantity") * 4).alias("motion"), (F.col("l_extendedprice") / 10).alias("focus"), (F.col("l_suppkey") % 60).cast("double").alias("d2"))


@query(f"""WITH {_CAND}, l AS (SELECT tile, list({{'frame': frame, 'motion': motion, 'focus': focus, 'd2': d2}} ORDER BY frame) AS x FROM c GROUP BY tile)
SELECT tile, list_reduce(x, lambda o, c: CASE WHEN abs(c.motion - o.motion) >= 50 THEN CASE WHEN c.motion < o.motion THEN c ELSE o END WHEN abs(c.focus - o.focus) >= 1000 THEN CASE WHEN c.focus > o.focus THEN c ELSE o END WHEN o.d2 > 25 + c.d2 THEN c ELSE o END).frame AS owner FROM l""")
def tile_owner(spark, sf_dir):
    return t.tile_owner(candidates(spark, sf_dir), ["tile"])


@query()
def tile_competition(spark, sf_dir):
    c = lineitem(spark, sf_dir).select((F.col("l_suppkey") % 7).alias("component"), (F.col("l_partkey") % 12).cast("int").alias("i"), (F.col("l_partkey") / 12 % 9).cast("int").alias("j"), F.col("l_orderkey").alias("frame"), (F.col("l_quantity") * 4).alias("motion"), (F.col("l_extendedprice") / 10).alias("focus"), (F.col("l_suppkey") % 60).cast("double").alias("d2"))
    return t.compete(c, "component")


_OWN = "o AS (SELECT l_suppkey % 5 AS comp, (l_partkey % 20)::INT AS i, (l_partkey // 20 % 15)::INT AS j, min(l_orderkey % 9) AS owner FROM lineitem GROUP BY ALL)"


def owners(spark, sf_dir):
    return lineitem(spark, sf_dir).groupBy((F.col("l_suppkey") % 5).alias("comp"), (F.col("l_partkey") % 20).cast("int").alias("i"), (F.floor(F.col("l_partkey") / 20) % 15).cast("int").alias("j")).agg(F.min(F.col("l_orderkey") % 9).alias("owner"))


@query(f"""WITH {_OWN}, s AS (SELECT comp, i + dx AS i, j + dy AS j, owner FROM o, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)), k AS (SELECT s.* FROM s JOIN o USING (comp, i, j)),
n AS (SELECT comp, i, j, k.owner, count(*) AS n FROM k GROUP BY ALL)
SELECT comp, i, j, owner FROM (SELECT *, row_number() OVER (PARTITION BY comp, i, j ORDER BY n DESC, (owner * 2 - i - 0.5) ** 2 + (owner - j - 0.5) ** 2, owner) AS r FROM n) WHERE r = 1""")
def owner_smooth(spark, sf_dir):
    o = owners(spark, sf_dir)
    centres = o.select("comp", "owner").distinct().withColumn("cx", F.col("owner") * 2.0).withColumn("cy", F.col("owner") * 1.0)
    return t.smooth_owners(o, centres, "comp")


@query(f"WITH {_OWN} SELECT DISTINCT comp, owner FROM o")
def contributing_frames(spark, sf_dir):
    return t.contributing_frames(owners(spark, sf_dir), "comp")


@query(f"WITH {_OWN} SELECT DISTINCT a.comp, least(a.owner, b.owner) AS a, greatest(a.owner, b.owner) AS b FROM o a JOIN o b ON a.comp = b.comp AND abs(a.i - b.i) + abs(a.j - b.j) = 1 AND a.owner <> b.owner")
def owner_neighbours(spark, sf_dir):
    return t.neighbour_owners(owners(spark, sf_dir), "comp")


@query("""WITH c AS (SELECT DISTINCT l_suppkey % 5 AS comp, (l_partkey % 20)::INT AS i, (l_partkey // 20 % 15)::INT AS j, l_orderkey % 9 AS frame FROM lineitem)
SELECT comp, i, j, frame AS owner FROM (SELECT *, row_number() OVER (PARTITION BY comp, i, j ORDER BY (frame * 2 - i - 0.5) ** 2 + (frame - j - 0.5) ** 2, frame) AS r FROM c) WHERE r = 1""")
def nearest_owner(spark, sf_dir):
    c = lineitem(spark, sf_dir).select((F.col("l_suppkey") % 5).alias("comp"), (F.col("l_partkey") % 20).cast("int").alias("i"), (F.floor(F.col("l_partkey") / 20) % 15).cast("int").alias("j"), (F.col("l_orderkey") % 9).alias("frame")).distinct()
    centres = c.select("comp", "frame").distinct().withColumn("cx", F.col("frame") * 2.0).withColumn("cy", F.col("frame") * 1.0)
    return t.nearest_owner(c, centres, "comp")


@query(f"""WITH {_OWN}, n AS (SELECT comp, i, j, (owner + i) % 4 AS owner FROM o WHERE owner <> 1), k AS (SELECT comp, i, j, owner AS was FROM o WHERE owner <> 2)
SELECT comp, i, j, owner, CASE WHEN owner IS NULL THEN 'blank' ELSE 'render' END AS action FROM k FULL JOIN n USING (comp, i, j) WHERE was IS DISTINCT FROM owner""")
def rebuild_changes(spark, sf_dir):
    o = owners(spark, sf_dir)
    new = o.filter("owner <> 1").withColumn("owner", (F.col("owner") + F.col("i")) % 4)
    return t.rebuild_changes(o.filter("owner <> 2"), new, ["comp", "i", "j"])


@query(f"WITH {_OWN}, c AS (SELECT l_suppkey % 5 AS comp, (l_partkey % 20)::INT AS i, (l_partkey // 20 % 15)::INT AS j, list_reverse_sort(list(DISTINCT l_orderkey % 9)) AS frames FROM lineitem GROUP BY ALL) SELECT comp, i, j, owner, array_to_string(frames, ',') AS frames FROM o JOIN c USING (comp, i, j)")
def tile_inspector(spark, sf_dir):
    c = lineitem(spark, sf_dir).select((F.col("l_suppkey") % 5).alias("comp"), (F.col("l_partkey") % 20).cast("int").alias("i"), (F.floor(F.col("l_partkey") / 20) % 15).cast("int").alias("j"), (F.col("l_orderkey") % 9).alias("frame"))
    return t.inspect(owners(spark, sf_dir), c, ["comp", "i", "j"]).withColumn("frames", F.array_join(F.col("frames").cast("array<string>"), ","))


@query(f"WITH {_OWN} SELECT comp, i, j, CASE WHEN owner > 0 THEN owner % 4 ELSE -1 END AS class FROM o")
def tile_class(spark, sf_dir):
    o = owners(spark, sf_dir)
    classes = o.filter("owner > 0").select("comp", "i", "j", (F.col("owner") % 4).alias("class"))
    return t.tile_class(o, classes, ["comp", "i", "j"]).select("comp", "i", "j", "class")
