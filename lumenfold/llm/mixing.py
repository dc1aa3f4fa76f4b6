"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) take weights in turn, share ``budget`` times all words,
and none takes more than ``most`` times its own words; what it can't take is shared out again by weight.
That is one water level: target = min(most * size, level * weight), found by raising the level until no
further source is full.

Documents: each source is read in a fixed pseudo-random order (MD5 of id, size, text and, among equal rows, a
running number) as often as its target needs. Whole passes take every document. The last pass takes a prefix of the order that stays within
the target, then another prefix of those remaining documents that still fit (``FILLS`` in all), then, up to
``TOPS`` times, the document that brings the source nearest its target, if any does. Documents are taken
whole, so a source ends a little off its target, on either side, usually by a few words.

Curriculum: source s has a weight schedule, piecewise linear over training time 0..1 (constant where
none is given). Its cumulative demand is the schedule's integral, scaled to its taken words. A copy's
training position is the time at which that integral reaches the words its source has supplied before
it, found by inverting the quadratic on the segment it falls in. ``by_position`` range-sorts.

Sums over a source are taken in two steps, over ``BUCKET`` documents and over the buckets, so a source
with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.operators.graph import dense_ids

from .common import cut, n_words, spread, table

WEIGHTS = (3, 1, 2)
#: Schedules, in the same turns as the weights: (time, weight) points over training time 0..1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)))
BUCKET = 4096
FILLS = 2
#: After them, each source takes the document that brings it nearest its target, so often.
TOPS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, turn, weight, target) from rows of (source, size); one row a source, null included."""
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).withColumn("skey", _key("source")))
    turns = dense_ids(per.withColumn("at", F.struct(F.col("source").isNull(), F.col("source"))), ["skey"], "at")
    per = per.join(turns.select("skey", (F.col("id") % len(weights)).cast("int").alias("turn")), "skey")
    per = cut(per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1)))
    want = budget * (per.agg(F.sum("source_size")).first()[0] or 0)
    cap, level, filled = F.col("source_size") * F.lit(float(most)), 0.0, -1
    while True:  # the level only rises, and every round but the last fills a source
        full = cap <= F.lit(level) * F.col("weight") if filled >= 0 else F.lit(False)
        open_, taken, n = per.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("source_size"))), F.sum(full.cast("int"))).first()
        if not open_ or n == filled:
            break
        level, filled = (want - most * (taken or 0)) / open_, n
    return per.select("source", "source_size", "n_docs", "turn", "weight", F.least(cap, F.lit(level) * F.col("weight") if open_ else cap).alias("target"))


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def _equals(rows: DataFrame) -> DataFrame:
    """Adds ``_copy``: a running number among rows that are equal in source, id, size and text, in two steps, by ``_part`` and inside."""
    same = ["skey", "doc_id", "size", "_tie"]
    counts = cut(rows.groupBy(*same, "_part").agg(F.count("*").alias("_c")))
    if not counts.groupBy(*same).agg(F.sum("_c").alias("_c")).filter("_c > 1").limit(1).count():
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    before = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    start = counts.select(F.xxhash64(*same).alias("_h"), "_part", *same, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*same, "_part").orderBy("_rid")) - 1
    rows = rows.withColumn("_at", inside).withColumn("_h", F.xxhash64(*same))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ["_h", "_part", *same]]
    return rows.alias("r").join(start.alias("s"), on).select("r.*", (F.col("r._at") + F.col("s._start")).alias("_copy")).drop("_at", "_h")


def _running(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over the rows of the same source up to and with this one, in the source's order."""
    rows = rows.withColumn("_amount", amount)
    sums = rows.groupBy("skey", "bucket").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("skey", "bucket").orderBy("ord", "_rid").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_in", F.sum("_amount").over(inside)).join(sums, ["skey", "bucket"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_amount", "_before", "_in")


def position(share: Column, schedule: list[tuple[float, float]]) -> Column:
    """Time in 0..1 at which a piecewise linear schedule [(time, weight), ...] has used ``share`` of its integral."""
    parts = [(t0, w0, t1, w1) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    areas = [(t1 - t0) * (w0 + w1) / 2 for t0, w0, t1, w1 in parts]
    out, done, total = F.lit(float(schedule[-1][0])), sum(areas), sum(areas)
    for (t0, w0, t1, w1), area in zip(reversed(parts), reversed(areas)):
        done -= area
        need = F.greatest(share * total - done, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0)))
        at = F.when(F.lit(w0) + root > 0, t0 + 2 * need / (F.lit(float(w0)) + root)).otherwise(F.lit(t0))
        out = F.when(share * total < done + area, at).otherwise(out)
    return out


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, budget: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, tie: Column | None = None, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, positions) for each row of ``docs``.

    ``positions`` holds the training position of each copy that the mix takes: size * cardinality(positions)
    are the document's words in the mix. A source's first pass comes before its second.

    A null source is a source of its own, the last. Null, empty and wordless texts have size 0: they take
    no words and count as taken once per whole pass. Rows that repeat an id are separate documents; rows
    with a null id are mixed like any other. Rows that are equal in every respect are spread over the order
    like others, and any of them may be the one that is taken. ``size_col`` gives sizes that
    are known already; ``tie`` tells texts apart, by default their hash. Columns named in ``keep`` are
    carried along, others ignored. No rows give no rows.
    """
    tie = F.xxhash64(F.col(text_col)) if tie is None else tie
    ids = (F.monotonically_increasing_id().alias("_rid"), F.spark_partition_id().alias("_part"))
    sized = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.col(size_col) if size_col else n_words(F.col(text_col))).alias("size"), tie.alias("_tie"), *keep, *ids))
    targets = source_targets(sized, weights, budget, most)
    targets = cut(targets.withColumn("skey", _key("source")).drop("source"))
    rows = spread(_equals(sized.withColumn("skey", _key("source"))), targets, "skey", "_rid")
    ordinal = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", F.coalesce(F.col("_tie").cast("string"), F.lit("")), "_copy").cast("binary"))
    rows = rows.withColumn("ord", ordinal).drop("_tie", "_part", "_copy").withColumn("bucket", F.floor(F.conv(F.substring("ord", 1, 8), 16, 10).cast("double") / 2.0**32 * F.ceil(F.col("n_docs") / BUCKET)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("passes", passes).withColumn("gap", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("more", F.lit(0))
    for _ in range(FILLS):
        open_ = (F.col("more") == 0) & (F.col("size") <= F.col("gap")) & (F.col("size") > 0)
        rows = _running(rows, F.when(open_, F.col("size")).otherwise(F.lit(0)), "_upto")
        took = open_ & (F.col("_upto") <= F.col("gap"))
        rows = rows.withColumn("_took", F.when(took, F.col("size")).otherwise(0))
        rows = cut(rows.withColumn("more", F.when(F.col("_took") > 0, 1).otherwise(F.col("more"))).drop("_upto"))
        used = rows.groupBy("skey").agg(F.sum("_took").alias("_used"))
        rows = spread(rows.drop("_took"), used, "skey", "_rid").withColumn("gap", F.col("gap") - F.col("_used")).drop("_used")
    for _ in range(TOPS):
        away = F.abs(F.col("size") - F.col("gap"))
        nearer = (F.col("more") == 0) & (F.col("size") > 0) & (away < F.col("gap"))
        best = rows.groupBy("skey").agg(F.min(F.when(nearer, F.struct(away.alias("away"), F.col("ord"), F.col("_rid"), F.col("size")))).alias("_best"))
        rows = spread(rows, best, "skey", "_rid").withColumn("more", F.when(F.col("_best._rid") == F.col("_rid"), 1).otherwise(F.col("more")))
        rows = rows.withColumn("gap", F.col("gap") - F.coalesce("_best.size", F.lit(0))).drop("_best")
    rows = cut(rows).withColumn("copies", (F.col("passes") + F.col("more")).cast("int"))
    # words that the source supplies before copy c of a document: c passes, and the documents before it in this one
    rows = _running(rows, F.col("size"), "_all")
    rows = _running(rows, F.col("size") * F.col("more"), "_last")
    total = rows.groupBy("skey").agg(F.sum(F.col("size") * F.col("more")).alias("_more"))
    rows = spread(rows, total, "skey", "_rid").withColumn("supplied", F.col("passes") * F.col("source_size") + F.col("_more"))

    def at(copy: Column) -> Column:
        inside = F.when(copy < F.col("passes"), F.col("_all") - F.col("size")).otherwise(F.col("_last") - F.col("size"))
        share = F.when(F.col("supplied") > 0, (copy * F.col("source_size") + inside) / F.col("supplied")).otherwise(F.lit(0.0))
        out = position(share, schedules[-1])
        for turn, schedule in enumerate(schedules[:-1]):
            out = F.when(F.col("turn") == turn, position(share, schedule)).otherwise(out)
        return out

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "source", "size", "source_size", "target", positions.alias("positions"), *keep)


def by_position(mixed: DataFrame) -> DataFrame:
    """``mixed`` range-sorted by the first position; documents that the mix leaves out come last."""
    order = [F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)), F.col("source"), F.col("doc_id")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = by_position(mix_sources(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).cast("long").alias("taken"), F.get("positions", F.lit(0)).alias("first_position"))
