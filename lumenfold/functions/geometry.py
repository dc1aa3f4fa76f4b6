"""Geometry as column expressions. Points are structs (x, y); polygons are arrays of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRONS = 1.73


def to_base(p: Column, offset: Column, scale: Column) -> Column:
    return scale * (p + offset)


def from_base(b: Column, offset: Column, scale: Column) -> Column:
    return b / scale - offset


def tile_index(p: Column, size: int = 256) -> Column:
    return F.floor(p / size).cast("int")


def tile_index_ref(p: Column, size: int = 256) -> Column:
    """Truncated, less one where negative: one too low at exact negative multiples."""
    return (p / size).cast("int") - F.when(p < 0, 1).otherwise(0)


def parent_index(i: Column) -> Column:
    return F.floor(i / 2).cast("int")


def pyramid_level(scale: Column, levels: int) -> Column:
    """Level for a view scale, kept inside [0, levels - 1]."""
    return F.least(F.greatest((F.log2(scale) + 0.5).cast("int"), F.lit(0)), F.lit(levels - 1))


def signed_area(polygon: Column) -> Column:
    """Shoelace area; the sign tells the direction. Fewer than three points have none."""
    turned = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    cross = F.zip_with(polygon, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(polygon) < 3, F.lit(0.0)).otherwise(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2)


def area(polygon: Column) -> Column:
    return F.abs(signed_area(polygon))


def area_mm2(polygon: Column, microns: float = MICRONS) -> Column:
    return area(polygon) * (microns / 1000) ** 2


def clockwise(polygon: Column) -> Column:
    """The polygon with its points in clockwise order (y down: positive shoelace area)."""
    return F.when(signed_area(polygon) < 0, F.reverse(polygon)).otherwise(polygon)


def length_um(x1: Column, y1: Column, x2: Column, y2: Column, microns: float = MICRONS) -> Column:
    return F.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * microns


def segment_y(x1: Column, y1: Column, x2: Column, y2: Column, x: Column) -> Column:
    """y of a segment at x; for a vertical one the larger y."""
    return F.when(x1 == x2, F.greatest(y1, y2)).otherwise(y1 + (y2 - y1) * (x - x1) / F.nullif(x2 - x1, F.lit(0)))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def footprint(x: Column, y: Column, w: Column, h: Column, round_view: Column, r: Column) -> Column:
    """Corners of a frame at (x, y): a rectangle, or for a round view an octagon cut by r / 2."""
    c = r / 2
    box = F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))
    octagon = F.array(point(x + c, y), point(x + w - c, y), point(x + w, y + c), point(x + w, y + h - c), point(x + w - c, y + h), point(x + c, y + h), point(x, y + h - c), point(x, y + c))
    return F.when(round_view, octagon).otherwise(box)


def contains(polygon: Column, x: Column, y: Column) -> Column:
    """Ray cast to the right: an odd number of crossed edges means inside."""
    turned = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    crossed = F.zip_with(polygon, turned, lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0))
    return F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1


def overlap_area(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Area shared by two boxes; 0 when apart."""
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def grow_box(lo: Column, hi: Column, value: Column) -> tuple[Column, Column]:
    """A field of view grown to hold ``value``; 0 on both ends means not set yet."""
    unset = (lo == 0) & (hi == 0)
    return F.when(unset, value).otherwise(F.least(lo, value)), F.when(unset, value).otherwise(F.greatest(hi, value))


def even(v: Column) -> Column:
    """Aligned down to the mosaic's two-pixel grid."""
    return v - F.pmod(v, F.lit(2))


def pack_edge(a: Column, b: Column) -> Column:
    """An unordered pair of 32-bit ids as one BIGINT."""
    return F.shiftleft(F.least(a, b).cast("long"), 32) + F.greatest(a, b).cast("long")


def pack_feature(image: Column, feature: Column) -> Column:
    """22 bits of image and 10 of feature."""
    return F.shiftleft(image.cast("long"), 10) + feature.cast("long")


def unpack_feature(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 10), key.bitwiseAND(F.lit(1023).cast("long"))


def mosaic_color(y: Column, x: Column) -> Column:
    """Colour of a BG-ordered mosaic at a place."""
    return F.when((y % 2 == 0) & (x % 2 == 0), "B").when((y % 2 == 1) & (x % 2 == 1), "R").otherwise("G")
