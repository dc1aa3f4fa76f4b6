"""Temporal queries: an event is a frame, its type the magnification, its user the slide."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.operators import temporal as t

from .registry import query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


_MS = "epoch_ms(ts)"


def _ms(column: str = "ts"):
    """Milliseconds since 1970, whatever the session's time zone (the table's times have none)."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


@query("SELECT event_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 0 AS valid FROM events")
def dark_dilation(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("dark", F.col("event_type") == "error")
    return t.dilate_dark(e, "dark", "event_id").select("event_id", "valid")


_PATHS = """
n AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS path FROM n)
"""


def paths(spark, sf_dir):
    return t.navigation_paths(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


@query(f"WITH {_PATHS} SELECT user_id, path, any_value(event_type) AS event_type, count(*) AS frames, min(event_id) AS lowest, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS ms FROM p GROUP BY user_id, path")
def nav_paths(spark, sf_dir):
    p = paths(spark, sf_dir)
    return p.groupBy("user_id", "path").agg(F.first("event_type").alias("event_type"), F.count("*").alias("frames"), F.min("event_id").alias("lowest"), F.expr("timestampdiff(MILLISECOND, min(ts), max(ts))").alias("ms"))


@query(f"""WITH {_PATHS}, s AS (SELECT user_id, path, sqrt((value - lag(value) OVER w) ** 2 + (event_id - lag(event_id) OVER w) ** 2) AS st FROM p WINDOW w AS (PARTITION BY user_id, path ORDER BY ts, event_id)),
g AS (SELECT user_id, path, count(*) AS n, coalesce(sum(st), 0) AS total FROM s GROUP BY ALL)
SELECT user_id, path, n, round(total, 6) AS total, round(CASE WHEN n > 2 THEN total / (n - 2) ELSE 0 END, 6) AS per_frame FROM g""")
def nav_distance(spark, sf_dir):
    d = t.path_distance(paths(spark, sf_dir), ["user_id", "path"], ["ts", "event_id"], "value", "event_id")
    return d.withColumn("total", F.round("total", 6)).withColumn("per_frame", F.round("per_frame", 6))


@query("""WITH p AS (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT *, greatest(trunc(0.4 * (n - 5)), 0) AS start FROM p) SELECT event_id, user_id, place FROM s WHERE place >= start AND place < start + 5""")
def path_section(spark, sf_dir):
    return t.path_section(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 0.4, 5).select("event_id", "user_id", "place")


@query("""WITH p AS (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS place FROM events)
SELECT event_id, user_id, place FROM p WHERE place >= trunc(0.7 * (user_id % 7 + 3)) AND place <= user_id % 7 + 3""")
def path_history(spark, sf_dir):
    return t.path_history(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("user_id") % 7 + 3, 0.3).select("event_id", "user_id", "place")


@query("""WITH f AS (SELECT user_id, epoch_ms(ts) AS t, event_id AS frame FROM events), q AS (SELECT user_id, event_id AS q, epoch_ms(ts) - 3600000 AS t0, epoch_ms(ts) + 18000000 AS t1 FROM events),
a AS (SELECT q.user_id, q.q, f.frame AS lo FROM q ASOF LEFT JOIN f ON q.user_id = f.user_id AND q.t0 >= f.t),
b AS (SELECT q.user_id, q.q, f.frame AS hi FROM q ASOF LEFT JOIN f ON q.user_id = f.user_id AND q.t1 <= f.t),
e AS (SELECT user_id, arg_min(frame, t) AS mn, arg_max(frame, t) AS mx FROM f GROUP BY 1)
SELECT a.user_id, a.q, coalesce(lo, mn) AS first, coalesce(hi, mx) AS last FROM a JOIN b USING (user_id, q) JOIN e USING (user_id)""")
def asof_interval(spark, sf_dir):
    e = events(spark, sf_dir)
    f = e.select("user_id", _ms().alias("t"), F.col("event_id").alias("frame"))
    q = e.select("user_id", F.col("event_id").alias("q"), (_ms() - 3_600_000).alias("t0"), (_ms() + 18_000_000).alias("t1"))
    return t.interval_to_frames(q, f, "user_id")


@query("""WITH p AS (SELECT *, row_number() OVER w AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, max(CASE WHEN event_type <> 'error' THEN place END) OVER e AS prev, max(CASE WHEN event_type = 'error' THEN place END) OVER e AS bad,
 arg_max(event_id, CASE WHEN event_type <> 'error' THEN place END) OVER e AS previous FROM p WINDOW e AS (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, previous, coalesce(bad > coalesce(prev, 0), false) AS crossed_bad FROM m""")
def last_resolved(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return t.last_resolved(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_id", ~bad, bad).select("event_id", "previous", "crossed_bad")


@query("""WITH RECURSIVE p AS (SELECT user_id, value AS x, (event_id % 13)::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
f AS (SELECT user_id, i, x, y, true AS hit FROM p WHERE i = 0
 UNION ALL SELECT p.user_id, p.i, CASE WHEN far THEN p.x ELSE f.x END, CASE WHEN far THEN p.y ELSE f.y END, far FROM (SELECT f.*, p.x AS nx, p.y AS ny, p.i AS ni, (p.x - f.x) ** 2 + (p.y - f.y) ** 2 >= 400 AS far FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1) f JOIN p ON p.user_id = f.user_id AND p.i = f.ni)
SELECT user_id, list(i ORDER BY i) AS kept FROM f WHERE hit GROUP BY user_id""")
def min_spacing_fold(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("y", F.col("event_id") % 13)
    return t.minimum_spacing(e, "user_id", ["ts", "event_id"], "value", "y", 20.0)


@query("SELECT event_id, round(2 * lag(value, 1) OVER w - lag(value, 2) OVER w, 6) AS projected FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def velocity_projection(spark, sf_dir):
    return t.project_velocity(events(spark, sf_dir), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("projected", 6).alias("projected"))


@query("""WITH p AS (SELECT event_id AS frame, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS matched_to, value AS x, (event_id % 13)::DOUBLE AS y FROM events)
SELECT a.frame, round(coalesce((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 1e7), 6) AS motion_blur, coalesce((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 1e7) < 10 AS sharp FROM p a LEFT JOIN p b ON a.matched_to = b.frame""")
def motion_blur(spark, sf_dir):
    e = events(spark, sf_dir)
    f = e.select(F.col("event_id").alias("frame"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("matched_to"), F.col("value").alias("x"), (F.col("event_id") % 13).cast("double").alias("y"))
    return t.motion_blur(f, f.select("frame", "x", "y")).select("frame", F.round("motion_blur", 6).alias("motion_blur"), "sharp")


@query(f"WITH {_PATHS} SELECT event_id, count(*) OVER (PARTITION BY user_id, path) < 5 AS suspended FROM p")
def component_prune(spark, sf_dir):
    return t.prune_components(paths(spark, sf_dir), ["user_id", "path"]).select("event_id", "suspended")


_FILL = """f AS (SELECT user_id, event_id AS frame, ts, CASE WHEN event_type = 'error' THEN 'bad' WHEN event_id % 5 = 0 THEN 'unaligned' ELSE 'aligned' END AS state, value AS x, (event_id % 13)::DOUBLE AS y,
 lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS matched_to, (event_id % 3)::DOUBLE AS rel_x, (event_id % 4)::DOUBLE AS rel_y FROM events)"""


@query(f"""WITH {_FILL}, j AS (SELECT a.*, CASE WHEN a.state = 'aligned' THEN a.x WHEN a.state = 'unaligned' THEN b.x - a.rel_x END AS gx, CASE WHEN a.state = 'aligned' THEN a.y WHEN a.state = 'unaligned' THEN b.y - a.rel_y END AS gy
 FROM f a LEFT JOIN f b ON a.user_id = b.user_id AND a.matched_to = b.frame AND b.state = 'aligned')
SELECT frame, round(last_value(gx IGNORE NULLS) OVER w, 6) AS fx, round(last_value(gy IGNORE NULLS) OVER w, 6) AS fy, state = 'bad' AS bad FROM j WINDOW w AS (PARTITION BY user_id ORDER BY ts, frame ROWS UNBOUNDED PRECEDING)""")
def position_fill(spark, sf_dir):
    e = events(spark, sf_dir)
    state = F.when(F.col("event_type") == "error", "bad").when(F.col("event_id") % 5 == 0, "unaligned").otherwise("aligned")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = e.select("user_id", F.col("event_id").alias("frame"), "ts", state.alias("state"), F.col("value").alias("x"), (F.col("event_id") % 13).cast("double").alias("y"), F.lag("event_id").over(w).alias("matched_to"), (F.col("event_id") % 3).cast("double").alias("rel_x"), (F.col("event_id") % 4).cast("double").alias("rel_y"))
    out = t.fill_positions(f, "user_id", ["ts", "frame"])
    return out.select("frame", F.round("fx", 6).alias("fx"), F.round("fy", 6).alias("fy"), "bad")


@query("SELECT p_partkey, coalesce(sum(p_size + 500) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS \"offset\" FROM part")
def layer_layout(spark, sf_dir):
    return t.layout_offsets(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], "p_size").select("p_partkey", "offset")


@query("SELECT user_id, arg_max(event_type, (epoch_us(ts)::HUGEINT * 1000000000 + event_id)) AS event_type, arg_max(value, (epoch_us(ts)::HUGEINT * 1000000000 + event_id)) AS value FROM events GROUP BY 1")
def latest_state(spark, sf_dir):
    return t.latest_state(events(spark, sf_dir), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("SELECT round(max(event_id) / nullif(max(epoch_ms(ts)) - min(epoch_ms(ts)), 0) * 1e6, 6) AS frames_per_ms FROM events")
def frame_rate(spark, sf_dir):
    return t.frames_per_ms(events(spark, sf_dir), "event_id", _ms()).select(F.round(F.col("frames_per_ms") * 1e6, 6).alias("frames_per_ms"))


@query("""WITH f AS (SELECT o_custkey AS k, o_orderkey % 40 AS i FROM orders GROUP BY ALL)
SELECT k, i, count(*) OVER (PARTITION BY k ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) = i + 1 - greatest(i - 1, 0) + 1 AS complete FROM f""")
def neighbours_complete(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 40).alias("i")).distinct()
    return t.neighbours_complete(f, "k", "i", reach=1)


@query("""WITH w AS (SELECT user_id, ts, event_id, event_type || CASE WHEN event_id % 11 = 0 THEN ';' ELSE '' END AS word, epoch_ms(ts) AS s, lead(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, string_agg(word || CASE WHEN event_id % 11 = 0 THEN '' WHEN n IS NULL THEN '.' WHEN n - (s + 400) > 40000000 THEN ',' ELSE '' END, ' ' ORDER BY ts, event_id) AS text FROM w GROUP BY user_id""")
def pause_punctuation(spark, sf_dir):
    e = events(spark, sf_dir)
    w = e.select("user_id", "ts", "event_id", F.concat("event_type", F.when(F.col("event_id") % 11 == 0, ";").otherwise("")).alias("word"), _ms().alias("s"), (_ms() + 400).alias("e"))
    return t.pause_punctuation(w, "user_id", ["ts", "event_id"], "word", "s", "e", 40_000_000)
