"""The stateful operators in batch form: the same functions over a bounded table, checked by rows."""

from __future__ import annotations

from pyspark.sql import functions as F


from .registry import query, table


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) AS start, event_type, count(*) AS frames, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def frames_by_window(spark, sf_dir):
    """Tumbling windows, as the stream's, over the whole table."""
    e = table(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("frames"), F.round(F.avg("value"), 6).alias("mean"))
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', window.start)")
    return w.select(start.alias("start"), "event_type", "frames", "mean")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def label_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


