"""Raw frames, frame lists, replay timestamps, directory scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import magnification as mag


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_frames(spark: SparkSession, path: str, width: int, height: int, exact: bool = True, glob: str = "*.[Rr]aw") -> DataFrame:
    """(path, frame_idx, label, content, good_size) of headerless frames; with ``exact`` wrongly sized files are left out.

    Select ``content`` only where pixels are needed: everything else is listed without reading files.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    good = F.col("length") == width * height
    out = f.select("path", numeric_key(base_name("path")).alias("frame_idx"), mag.label_from_name(base_name("path")).alias("label"), "content", good.alias("good_size"))
    return out.filter("good_size") if exact else out


def numeric_key(name: Column) -> Column:
    """Number a name sorts by: all of it, its first run of digits, or its last."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.coalesce(stem.try_cast("long"), F.regexp_extract(stem, r"^\D*(\d+)", 1).try_cast("long"), F.regexp_extract(stem, r"(\d+)\D*$", 1).try_cast("long"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(frame_idx, path): white-space separated paths in order."""
    t = spark.read.text(path, wholetext=True)
    words = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    return t.select(F.posexplode(words).alias("frame_idx", "path")).select(F.col("frame_idx").cast("long").alias("frame_idx"), "path")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line, without carriage returns, spaces and tabs; empty lines are skipped."""
    return spark.read.text(path).select(F.regexp_replace("value", r"[\r \t]", "").alias("name")).filter("name <> ''")


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """(frame_idx, ts_ms) from lines of two numbers."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(F.get(p, F.lit(0)).try_cast("long").alias("frame_idx"), F.get(p, F.lit(1)).try_cast("long").alias("ts_ms")).filter("frame_idx is not null and ts_ms is not null")


def replay(frames: DataFrame, timestamps: DataFrame | None = None, per_second: float = 20.0) -> DataFrame:
    """The list with its times; frames without one, or all without a file, follow the fixed rate."""
    paced = (F.col("frame_idx") * (1000 / per_second)).cast("long")
    if timestamps is None:
        return frames.withColumn("ts_ms", paced)
    return frames.join(timestamps, "frame_idx", "left").withColumn("ts_ms", F.coalesce("ts_ms", paced))


def capture_groups(paths: DataFrame, only_complete: bool = False) -> DataFrame:
    """(subdir, case_no, x2, x4, x10, x20, x40, complete): paths by magnification. The letter is not part of the key."""
    name, pattern = base_name("path"), r"^([A-Z])([123])_(2|4|10|20|40)x\.raw$"
    p = paths.withColumn("_n", name).filter(F.col("_n").rlike(pattern))
    p = p.select(F.element_at(F.split("path", "/"), -2).alias("subdir"), F.regexp_extract("_n", pattern, 2).cast("int").alias("case_no"), F.concat(F.lit("x"), F.regexp_extract("_n", pattern, 3)).alias("m"), "path")
    g = p.groupBy("subdir", "case_no").pivot("m", ["x2", "x4", "x10", "x20", "x40"]).agg(F.min("path"))
    full = F.col("x2").isNotNull() & F.col("x4").isNotNull() & F.col("x10").isNotNull() & F.col("x20").isNotNull() & F.col("x40").isNotNull()
    g = g.withColumn("complete", full)
    return g.filter("complete") if only_complete else g


def numbered_order(names: Column) -> list[Column]:
    """Sort keys: numeric names first, in numeric order, then the rest by name."""
    n = names.try_cast("long")
    return [n.isNull(), n, names]


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor digits only."""
    return spark.read.text(path).filter(~F.col("value").rlike(r"^\s*[0-9]*\s*$"))


def latest_label(frames: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """Each frame with the newest label at or before its time. ``labels``: (by, t, label); ``frames``: (by, t, frame)."""
    from pyspark.sql import Window

    rows = frames.select(by, "t", "frame", F.lit(None).cast("string").alias("label"), F.lit(1).alias("side")).union(labels.select(by, "t", F.lit(None).cast("long").alias("frame"), F.trim("label").alias("label"), F.lit(0).alias("side")))
    w = Window.partitionBy(by).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("label", F.last("label", ignorenulls=True).over(w)).filter("side = 1").select(by, "t", "frame", "label")


def write_timestamps(frames: DataFrame, path: str) -> None:
    frames.select("frame_idx", "ts_ms").orderBy("frame_idx").coalesce(1).write.mode("overwrite").csv(path, sep=" ")


def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.coalesce(1).write.mode("overwrite").csv(path, sep=";", header=True)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").csv(path, sep="\t", header=True)


def two_step_travel(frames: DataFrame) -> DataFrame:
    """(frame, path, travel): squared displacement over two links. ``frames``: (frame, path, matched_to, x, y)."""
    a = frames.select(F.col("frame").alias("matched_to"), F.col("matched_to").alias("_up"))
    b = frames.select(F.col("frame").alias("_up"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    j = frames.join(a, "matched_to").join(b, "_up")
    return j.select("frame", "path", ((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2).alias("travel"))
