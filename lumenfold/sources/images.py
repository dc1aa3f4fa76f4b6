"""Image sinks: PNG files from tiles and mosaics, frames as raw files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import pixels as px


def png(img: np.ndarray) -> bytes:
    """An 8-bit gray, BGR or BGRA array as a PNG file."""
    if img.ndim == 2:
        kind, rows = 0, img[:, :, None]
    else:
        kind = 2 if img.shape[2] == 3 else 6
        rows = img[..., [2, 1, 0] if kind == 2 else [2, 1, 0, 3]]
    data = b"".join(b"\x00" + r.tobytes() for r in np.ascontiguousarray(rows))
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">2I5B", img.shape[1], img.shape[0], 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(data, 6)) + part(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Inverse of ``png`` for files it wrote (unfiltered rows)."""
    at, body, head = 8, b"", b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        name = data[at + 4 : at + 8]
        if name == b"IHDR":
            head = data[at + 8 : at + 8 + n]
        elif name == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, _, kind, *_ = struct.unpack(">2I5B", head)
    c = {0: 1, 2: 3, 6: 4}[kind]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)[:, 1:].reshape(h, w, c)
    return rows[..., 0] if c == 1 else rows[..., [2, 1, 0] if c == 3 else [2, 1, 0, 3]]


def mosaics(tiles: DataFrame, by: str, size: int = 256) -> DataFrame:
    """(by, i, j, png): one image a group of at most 64 x 64 tiles, so that a large mosaic is many files.

    ``tiles``: (by, i, j, bgra). ``i`` and ``j`` of the result count those blocks.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        t = {(r.i, r.j): np.frombuffer(r.bgra, np.uint8).reshape(size, size, 4) for r in part.itertuples()}
        return pd.DataFrame({by: [part[by].iloc[0]], "i": [part["bi"].iloc[0]], "j": [part["bj"].iloc[0]], "png": [png(px.assemble(t, size))]})

    kind = tiles.schema[by].dataType.simpleString()
    blocks = tiles.withColumn("bi", F.floor(F.col("i") / 64)).withColumn("bj", F.floor(F.col("j") / 64))
    return blocks.groupBy(by, "bi", "bj").applyInPandas(run, f"{by} {kind}, i long, j long, png binary")


def full_tiles(tiles: DataFrame, size: int = 256, least: float = 0.95) -> DataFrame:
    """Tiles with more than ``least`` of their pixels not black, as PNG."""

    @F.pandas_udf("filled double, png binary")
    def encode(bgra: pd.Series) -> pd.DataFrame:
        a = [np.frombuffer(b, np.uint8).reshape(size, size, 4) for b in bgra]
        return pd.DataFrame({"filled": [float((x[..., :3].max(axis=2) > 0).mean()) for x in a], "png": [png(x) for x in a]})

    out = tiles.withColumn("e", encode("bgra"))
    return out.filter(F.col("e.filled") > least).select(*[c for c in tiles.columns if c != "bgra"], F.col("e.png").alias("png"))


def debayered(frames: DataFrame, width: int, height: int, scale: float = 1.0) -> DataFrame:
    """Frames as colour PNGs; wrongly sized ones have none."""

    @F.pandas_udf("binary")
    def convert(content: pd.Series) -> pd.Series:
        def one(c):
            raw = px.decode(c, width, height)
            return None if raw is None else png(np.dstack([px.resize(p, scale) for p in np.moveaxis(px.debayer(raw), 2, 0)]) if scale != 1 else px.debayer(raw))

        return content.map(one)

    return frames.withColumn("png", convert("content")).drop("content")


def pyramid_of(images: DataFrame, by: str, size: int = 256) -> DataFrame:
    """(by, level, i, j, bgra): tiles of whole images (by, png), halved level by level until one tile holds all."""

    def run(parts):
        for part in parts:
            rows = []
            for key, data in zip(part[by], part["png"]):
                img, level = read_png(data), 0
                img = img if img.ndim == 3 and img.shape[2] == 4 else np.dstack([img if img.ndim == 3 else np.dstack([img] * 3), np.full(img.shape[:2], 255, np.uint8)])
                while True:
                    rows += [(key, level, i, j, t.tobytes()) for (i, j), t in px.cut_tiles(img, size).items()]
                    if max(img.shape[:2]) <= size:
                        break
                    img, level = px.resize_half(img), level + 1
            yield pd.DataFrame(rows, columns=[by, "level", "i", "j", "bgra"])

    kind = images.schema[by].dataType.simpleString()
    return images.select(by, "png").mapInPandas(run, f"{by} {kind}, level int, i int, j int, bgra binary")


def write_raw(stream_or_batch: DataFrame, path: str) -> DataFrame:
    """Frames (frame_idx, label, content) laid out as rows that a writer stores: (path, content)."""
    name = F.concat(F.lit(path.rstrip("/") + "/"), F.col("frame_idx").cast("string"), F.coalesce(F.concat(F.lit("_"), F.lpad(F.regexp_extract("label", r"(\d+)", 1), 2, "0")), F.lit("")), F.lit(".Raw"))
    return stream_or_batch.select(name.alias("path"), "content")
