"""Slides on disk: a binary header and one raw file of tiles a layer, as a Python data source.

Native byte order, no padding. Header: u16 layers; f32 x, y, w, h; u32 length and label bytes; f32 frames
per ms; u16 frames; per frame i32 x, y; i8 component; i64 time; u8 scales, each u8 label and f32 scale; per
layer f32 scale, offset x, offset y, u8 magnification, u8 component, f32 x, y, w, h, u16 tiles, each i32 i, j.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER, LAYER = "slide.pcHdr", "layer{}.pcRawLayer"


def pack_header(s: dict) -> bytes:
    label = s["label"].encode("utf-8")
    out = [struct.pack("=H4f", len(s["layers"]), *s["bounds"]), struct.pack("=I", len(label)), label, struct.pack("=fH", s["frames_per_ms"], len(s["frames"]))]
    out += [struct.pack("=2i", f["x"], f["y"]) for f in s["frames"]]
    out += [struct.pack("=b", f["component"]) for f in s["frames"]]
    out += [struct.pack("=q", f["ts_ms"]) for f in s["frames"]]
    out.append(struct.pack("=B", len(s["scales"])))
    out += [struct.pack("=Bf", k, v) for k, v in s["scales"].items()]
    for y in s["layers"]:
        out.append(struct.pack("=3f2B4fH", y["scale"], *y["offset"], y["mag"], y["component"], *y["bounds"], len(y["tiles"])))
        out += [struct.pack("=2i", i, j) for i, j in y["tiles"]]
    return b"".join(out)


def unpack_header(data: bytes) -> dict:
    """Raises ValueError where the header ends early."""
    at = 0

    def take(kind: str) -> tuple:
        nonlocal at
        n = struct.calcsize("=" + kind)
        if at + n > len(data):
            raise ValueError(f"slide header ends at byte {len(data)}, {at + n} needed")
        at += n
        return struct.unpack("=" + kind, data[at - n : at])

    layers, *bounds = take("H4f")
    (n,) = take("I")
    label = bytes(take(f"{n}s")[0]).decode("utf-8")
    rate, frames = take("fH")
    xy = take(f"{2 * frames}i")
    member, ts = take(f"{frames}b"), take(f"{frames}q")
    scales = {}
    for _ in range(take("B")[0]):
        k, v = take("Bf")
        scales[k] = v
    out = []
    for _ in range(layers):
        scale, ox, oy, mag, component, x, y, w, h, tiles = take("3f2B4fH")
        ij = take(f"{2 * tiles}i")
        out.append({"scale": scale, "offset": (ox, oy), "mag": mag, "component": component, "bounds": (x, y, w, h), "tiles": list(zip(ij[::2], ij[1::2]))})
    rows = [{"x": x, "y": y, "component": c, "ts_ms": t} for x, y, c, t in zip(xy[::2], xy[1::2], member, ts)]
    return {"label": label, "bounds": tuple(bounds), "frames_per_ms": rate, "frames": rows, "scales": scales, "layers": out}


class _Layer(InputPartition):
    def __init__(self, path: str, label: str, index: int, layer: dict, size: int):
        self.path, self.label, self.index, self.layer, self.size = path, label, index, layer, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("tilesize", 256))

    def partitions(self) -> list[InputPartition]:
        out = []
        for name in slide_folders(self.root):
            with open(os.path.join(name, HEADER), "rb") as f:
                s = unpack_header(f.read())
            out += [_Layer(os.path.join(name, LAYER.format(k)), s["label"], k, y, self.size) for k, y in enumerate(s["layers"])]
        return out

    def read(self, p: _Layer) -> Iterator[tuple]:
        n = p.size * p.size * 4
        with open(p.path, "rb") as f:
            for i, j in p.layer["tiles"]:
                data = f.read(n)
                if len(data) != n:
                    raise ValueError(f"{p.path} ends inside tile ({i}, {j})")
                yield (p.label, p.index, p.layer["component"], p.layer["mag"], float(p.layer["scale"]), i, j, data)


class _Message(WriterCommitMessage):
    def __init__(self, tiles: dict[int, list]):
        self.tiles = tiles


class _Writer(DataSourceWriter):
    """One slide a write: the rows of a layer must be in one partition (repartition by layer)."""

    def __init__(self, options: dict):
        self.path, self.label = options["path"], options.get("label", "slide")
        self.size = int(options.get("tilesize", 256))

    def write(self, rows: Iterator) -> _Message:
        tiles: dict[int, list] = {}
        os.makedirs(self.path, exist_ok=True)
        files: dict[int, object] = {}
        try:
            for r in rows:
                if r.layer not in files:
                    files[r.layer] = open(os.path.join(self.path, LAYER.format(r.layer)), "wb")
                files[r.layer].write(bytes(r.bgra))
                tiles.setdefault(r.layer, []).append((r.i, r.j, r.component, r.mag, r.scale))
        finally:
            for f in files.values():
                f.close()
        return _Message(tiles)

    def commit(self, messages: list) -> None:
        tiles = {k: v for m in messages if m for k, v in m.tiles.items()}
        layers = []
        for k in range(max(tiles, default=-1) + 1):
            t = tiles.get(k, [])
            ij = [(i, j) for i, j, *_ in t]
            lo = (min((i for i, _ in ij), default=0), min((j for _, j in ij), default=0))
            hi = (max((i for i, _ in ij), default=-1), max((j for _, j in ij), default=-1))
            box = (lo[0] * self.size, lo[1] * self.size, (hi[0] - lo[0] + 1) * self.size, (hi[1] - lo[1] + 1) * self.size)
            layers.append({"scale": t[0][4] if t else 1.0, "offset": (0.0, 0.0), "mag": t[0][3] if t else 0, "component": t[0][2] if t else 0, "bounds": box, "tiles": ij})
        header = {"label": self.label, "bounds": layers[0]["bounds"] if layers else (0, 0, 0, 0), "frames_per_ms": 0.0, "frames": [], "scales": {}, "layers": layers}
        with open(os.path.join(self.path, HEADER), "wb") as f:
            f.write(pack_header(header))

    def abort(self, messages: list) -> None:
        """A slide without a header does not count as one."""


class SlideSource(DataSource):
    """``spark.read.format("slide").load(folder)``: tiles of every slide below a folder, a partition a layer.

    The layout is that of a mounted share; for anything larger keep tiles as Parquet (``write_tiles``).
    """

    @classmethod
    def name(cls) -> str:
        return "slide"

    def schema(self) -> str:
        return "slide string, layer int, component int, mag int, scale float, i int, j int, bgra binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def slide_folders(root: str) -> list[str]:
    """Folders that hold a slide header: numeric names first, in numeric order, then by name."""
    found = [d for d, _, files in os.walk(root) if HEADER in files]
    return sorted(found, key=lambda d: (not os.path.basename(d).isdigit(), int(os.path.basename(d)) if os.path.basename(d).isdigit() else 0, d))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(slide, frame_idx, x, y, component, ts_ms) of the frames in every header below ``path``, on any file system."""
    def parse(parts):
        import pandas as pd

        for part in parts:
            for content in part["content"]:
                s = unpack_header(content)
                yield pd.DataFrame([(s["label"], k, f["x"], f["y"], f["component"], f["ts_ms"]) for k, f in enumerate(s["frames"])], columns=["slide", "frame_idx", "x", "y", "component", "ts_ms"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcHdr").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(parse, "slide string, frame_idx long, x int, y int, component int, ts_ms long")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Parquet by component and level, so that a viewport prunes to its level."""
    tiles.repartition("component", "level").sortWithinPartitions("component", "level", "i", "j").write.mode("overwrite").partitionBy("component", "level").parquet(path)


def live_layers(layers: DataFrame) -> DataFrame:
    """Layers that are not suspended, largest scale first."""
    return layers.filter("not suspended").orderBy(F.desc("scale"), "component")


def load_case(spark: SparkSession, path: str) -> DataFrame:
    """(slide, frames, concepts): every slide below a folder with how many frames its header and how many spans
    its concept file, if any, hold. A concept file belongs to the slide whose folder it is in."""
    from .concepts import read_concepts

    folder = lambda c: F.element_at(F.split(c, "/"), -2)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcHdr").option("recursiveFileLookup", "true").load(path)

    @F.pandas_udf("label string, frames long")
    def head(content):
        import pandas as pd

        s = [unpack_header(c) for c in content]
        return pd.DataFrame({"label": [x["label"] for x in s], "frames": [len(x["frames"]) for x in s]})

    slides = files.select(folder(F.col("path")).alias("folder"), head("content").alias("h")).select("folder", F.col("h.label").alias("slide"), "h.frames")
    spans = read_concepts(spark, path.rstrip("/") + "/*/*.json").groupBy(folder(F.col("file")).alias("folder")).agg(F.count("*").alias("concepts"))
    return slides.join(spans, "folder", "left").select("slide", "frames", F.coalesce("concepts", F.lit(0)).alias("concepts"))
