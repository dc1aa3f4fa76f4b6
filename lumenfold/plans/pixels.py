"""Pixel queries: a page's bytes are a small frame. Kernels run inside Arrow-fed pandas UDFs."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenfold.functions import pixels as px

from .registry import query, table

W = 32


def _raw(spark, sf_dir):
    """Each page's bytes as a frame 32 pixels wide, filled up with zeros to whole pairs of rows, 8 rows at least."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = F.greatest(F.ceil(F.octet_length(html) / (2 * W)) * 2, F.lit(8)).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", rows.alias("rows"), F.rpad(html, rows * W, F.lit(b"\0")).alias("content"))


def _frame(content: bytes) -> np.ndarray:
    return px.decode(content, W, len(content) // W)


@query()
def frame_focus(spark, sf_dir):
    """Focus measure, brightness and strongest corner of each frame."""

    @F.pandas_udf("focus double, mean double, white boolean, x long, y long")
    def measure(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            raw = _frame(c)
            g = px.gray(px.debayer(raw))
            k = px.corners(g, 1)
            rows.append((round(px.sobel_energy(raw), 6), round(float(g.mean()), 6), px.mostly_white(g), int(k[0, 0]) if len(k) else -1, int(k[0, 1]) if len(k) else -1))
        return pd.DataFrame(rows, columns=["focus", "mean", "white", "x", "y"])

    return _raw(spark, sf_dir).select("page_id", measure("content").alias("m")).select("page_id", "m.*")


@query()
def frame_shift(spark, sf_dir):
    """Phase correlation of each frame with itself moved by (3, 5)."""

    @F.pandas_udf("dy int, dx int")
    def shift(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            g = px.gray(px.debayer(_frame(c))).astype(float)
            rows.append(px.phase_shift(g, np.roll(g, (3, 5), (0, 1)))[:2])
        return pd.DataFrame(rows, columns=["dy", "dx"])

    return _raw(spark, sf_dir).select("page_id", shift("content").alias("m")).select("page_id", "m.*")


@query()
def mosaic_export(spark, sf_dir):
    """Each frame cut to tiles, assembled again, and its half-size parent: sizes and checksums."""

    @F.pandas_udf("height long, width long, tiles long, crc long, half_crc long")
    def assemble(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            tiles = px.cut_tiles(_frame(c), W)
            m = px.assemble(tiles, W)
            rows.append((*m.shape, len(tiles), zlib.crc32(m.tobytes()), zlib.crc32(px.resize_half(m).tobytes())))
        return pd.DataFrame(rows, columns=["height", "width", "tiles", "crc", "half_crc"])

    return _raw(spark, sf_dir).select("page_id", assemble("content").alias("m")).select("page_id", "m.*")


@query("""WITH r AS (SELECT page_id, hex(coalesce(html, '')) AS hx, length(hx) // 2 AS n, greatest((n + 63) // 64 * 2, 8) AS rows FROM pages),
b AS (SELECT page_id, rows, list_transform(range(0, rows * 32), lambda i: CASE WHEN i < n THEN (strpos('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 1 ELSE 0 END) AS v FROM r),
m AS (SELECT page_id, quantile_disc(x, 0.5) AS level FROM (SELECT page_id, unnest(v) AS x FROM b) GROUP BY 1),
c AS (SELECT page_id, rows, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM b),
h AS (SELECT page_id, sum(s)::BIGINT AS half FROM (SELECT page_id, floor(sum(x) / 4.0 + 0.5) AS s FROM c GROUP BY page_id, i // 64, i % 32 // 2) GROUP BY 1),
g AS (SELECT page_id, rows, coalesce(sum(x) FILTER (i // 32 % 2 = 0 AND i % 2 = 0), 0)::BIGINT AS blue, coalesce(sum(x) FILTER (i // 32 % 2 = 0 AND i % 2 = 1), 0)::BIGINT AS green_1, coalesce(sum(x) FILTER (i // 32 % 2 = 1 AND i % 2 = 0), 0)::BIGINT AS green_2, coalesce(sum(x) FILTER (i // 32 % 2 = 1 AND i % 2 = 1), 0)::BIGINT AS red,
 sum(least(floor(x * CASE WHEN i // 32 % 2 = 0 AND i % 2 = 0 THEN 2.25 WHEN i // 32 % 2 = 1 AND i % 2 = 1 THEN 0.75 ELSE 1.0 END::DOUBLE + 0.5), 255))::BIGINT AS gained, count(*) FILTER (x > 100) * 2 > count(*) AS white FROM c GROUP BY ALL)
SELECT page_id, rows::BIGINT AS rows, blue, green_1, green_2, red, gained, half, level::BIGINT AS level, list_count(list_filter(v, lambda x: x > level))::BIGINT AS above,
 list_sum(list_transform(range(0, rows * 32), lambda i: greatest(v[i + 1], v[(rows - 1 - i // 32) * 32 + i % 32 + 1])))::BIGINT AS merged, white, round((0.11 * v[69] + 0.59 * (v[70] + v[101]) / 2 + 0.30 * v[102])::DOUBLE, 6) AS luminance
FROM b JOIN m USING (page_id) JOIN h USING (page_id) JOIN g USING (page_id, rows)""")
def frame_planes(spark, sf_dir):
    """Sums of each frame's colour planes, of its gained, halved and mirrored-and-merged images; its median, and one place's luminance."""

    @F.pandas_udf("blue long, green_1 long, green_2 long, red long, gained long, half long, level long, above long, merged long, white boolean, luminance double")
    def measure(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            raw = _frame(c)
            planes = px.split_colors(raw)
            level, bits = px.threshold_bits(raw)
            images = (*(planes[k] for k in ("B", "G1", "G2", "R")), px.color_gain(raw, 2.25, 1.0, 0.75), px.resize_half(raw))
            sums = [int(x.sum(dtype=np.int64)) for x in images]
            merged = px.merge_masks(raw, raw[::-1])
            rows.append((*sums, level, int(np.bitwise_count(bits).sum()), int(merged.sum(dtype=np.int64)), px.mostly_white(raw, 100), round(px.luminance_at(raw, 3, 5), 6)))
        return pd.DataFrame(rows, columns=["blue", "green_1", "green_2", "red", "gained", "half", "level", "above", "merged", "white", "luminance"])

    return _raw(spark, sf_dir).select("page_id", F.col("rows").cast("long").alias("rows"), measure("content").alias("m")).select("page_id", "rows", "m.*")


@query("SELECT page_id, strlen(html) = 4096 AS good_size, strlen(html) AS n FROM pages")
def frame_size_check(spark, sf_dir):
    n = F.octet_length("html")
    return table(spark, sf_dir, "pages").select("page_id", (n == 4096).alias("good_size"), n.cast("long").alias("n"))
