"""Objectives: names, scales and the rules that read them from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Objective codes in file names and the labels they stand for.
LABELS = {"02": "2x", "04": "4x", "10": "10x", "20": "20x", "40": "40x"}


def label_from_name(name: Column) -> Column:
    """Label by the digits after the first underscore; null if there is none or it isn't an objective."""
    code = F.regexp_extract(name, r"^[^_]*_(\d\d)", 1)
    return F.coalesce(*[F.when(code == k, v) for k, v in LABELS.items()])


def power(label: Column) -> Column:
    return F.regexp_extract(label, r"([0-9]+)x", 1).try_cast("int")


def relative_scale(label: Column, base: int = 2) -> Column:
    """Scale of a label against the base objective."""
    return F.lit(float(base)) / power(label)


def microns_per_pixel(label: Column, at_40x: float = 0.0865) -> Column:
    return F.lit(at_40x * 40) / power(label)


def nearest_label(scale: Column, base: int = 2) -> Column:
    """Label whose relative scale is nearest; the lower power wins ties."""
    best = F.array_min(F.array(*[F.struct(F.abs(scale - base / int(v[:-1])).alias("d"), F.lit(int(v[:-1])).alias("p"), F.lit(v).alias("label")) for v in LABELS.values()]))
    return best["label"]


def effective_label(frame: Column, component: Column) -> Column:
    return F.coalesce(frame, component)


def compatible_strict(image: Column, other: Column) -> Column:
    """Streaming rule: a known label on this side must equal the other, known or not."""
    return image.isNull() | image.eqNullSafe(other)


def compatible(a: Column, b: Column) -> Column:
    """Search rule: only two known, different labels exclude each other."""
    return a.isNull() | b.isNull() | (a == b)


def slide_name(index: Column) -> Column:
    """1A .. 1Z, 2A .. by running index from 0."""
    return F.concat((F.floor(index / 26) + 1).cast("string"), F.chr(65 + index % 26))


def quality(readable: Column, dark: Column, features: Column, least: int = 250) -> Column:
    return F.when(~readable, "bad_file").when(dark, "underexposed").when(features < least, "low_features").otherwise("good")


def is_good(label: Column) -> Column:
    """Neither bad label; an unlabelled frame is good."""
    return ~F.coalesce(label.isin("underexposed", "low_features"), F.lit(False))


def label_by_range(index: Column, ranges: list[tuple[int, int, str]]) -> Column:
    """Label of the first range [from, to] that holds the index; null outside all."""
    return F.coalesce(*[F.when(index.between(lo, hi), label) for lo, hi, label in ranges])
