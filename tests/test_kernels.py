"""Closed-form cases of pixel kernels, homographies, and of the small readers and writers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import pixels as px
from lumenfold.operators import graph, matching
from lumenfold.sources import frames, slides
from lumenfold.streaming import stateful


def test_luminance_weights():
    raw = np.array([[100, 50], [30, 200]], np.uint8)
    assert px.luminance_at(raw, 1, 1) == pytest.approx(0.11 * 100 + 0.59 * 40 + 0.30 * 200)


def test_dark_ring():
    lit = np.full((1000, 1000), 90, np.uint8)
    assert not px.mostly_black(lit, 800) and px.mostly_black(lit * 0, 800)
    half = lit.copy()
    half[:500] = 0  # half of the 40 places: more than 16
    assert px.mostly_black(half, 800) and not px.mostly_black(half, 800, most=30)


def test_objective_by_brightness():
    img = np.zeros((600, 600), np.uint8)
    img[172:428, 172:428] = 150
    assert px.is_2x(img) and px.is_4x(img)
    img[172:428, 172:428] = 119
    assert not px.is_2x(img) and not px.is_4x(img)


def test_registration_image_is_the_centre():
    raw = np.zeros((64, 64), np.uint8)
    raw[16:48, 16:48] = 80  # wider than the crop: colours are interpolated over its border
    out = px.registration_image(raw, 0.5, 0.25)
    assert out.shape == (8, 8) and (out == 80).all()


def test_flat_field_evens_out():
    shade = np.full((8, 8), 120, np.uint8)
    field = px.flat_field(shade)
    assert np.allclose(field, 0.5)
    assert (px.correct(np.full((8, 8, 3), 60, np.uint8), field) == 120).all()
    assert (px.correct(np.full((8, 8, 3), 200, np.uint8), field) == 255).all()


def test_brighten_and_gain():
    assert px.brighten(np.array([[0, 1, 100, 255]], np.uint8)).tolist() == [[0, 1, 158, 255]]
    assert px.color_gain(np.full((2, 2), 100, np.uint8), 0.5, 1.0, 3.0).tolist() == [[50, 100], [100, 255]]


def test_spectrum_of_a_constant():
    s = px.log_spectrum(np.full((8, 8), 2.0))
    assert s[4, 4] == pytest.approx(np.log1p(128)) and np.isclose(np.delete(s.ravel(), 36), 0).all()


def test_bits_lowest_first():
    img = np.array([0, 9, 9, 0, 0, 0, 0, 9, 9], np.uint8).reshape(1, 9)
    level, bits = px.threshold_bits(img, 0.5)
    assert level == 0 and bits.tolist() == [0b10000110, 1]


def test_channels_and_normalisation():
    assert px.swap_rgb(np.array([[[1, 2, 3, 4]]], np.uint8)).tolist() == [[[3, 2, 1]]]
    out = px.normalise(np.full((2, 3, 3), 255, np.uint8))
    assert out.shape == (3, 2, 3) and out[0, 0, 0] == pytest.approx((1 - 0.485) / 0.229, rel=1e-5)


def test_seed_is_inside():
    mask = np.zeros((40, 40), np.uint8)
    mask[10:31, 5:26] = 1
    y, x = px.seed_point(mask)
    assert mask[y - 4 : y + 5, x - 4 : x + 5].all()


def test_first_of_equal_scores_stays():
    a, b = np.full((1, 3), 1), np.full((1, 3), 2)
    assert px.zbuffer([(a, np.array([[0.5, 0.5, 0.0]])), (b, np.array([[0.5, 0.9, 0.0]]))]).tolist() == [[1, 2, 0]]


def test_quality_shapes():
    for shape, centre, rim in (("dome", 1, 0), ("cone", 1, 0), ("donut", 0, 0)):
        s = px.quality_score(101, 101, shape)
        assert s[50, 50] == pytest.approx(centre, abs=0.01) and s[0, 0] == pytest.approx(rim, abs=0.01)
    assert px.quality_score(101, 101, "donut").max() > 0.98


def test_mask_union_and_replacement():
    a, b = np.array([[0, 255]]), np.array([[255, 0]])
    assert px.merge_masks(a, b).tolist() == [[255, 255]] and px.merge_masks(a, b, True).tolist() == [[255, 0]]


def test_flattened_layer():
    gray, mask = px.flatten_layer({(0, 0): np.full((8, 8, 4), 80, np.uint8), (2, 0): np.full((8, 8, 4), 80, np.uint8)}, 0.5, 8)
    assert gray.shape == mask.shape and sorted(set(mask[1:-1].ravel().tolist())) != [255]
    assert gray.max() == 80 and mask.max() == 255 and mask.min() == 0


def test_homography_of_known_points():
    rng = np.random.default_rng(3)
    a = rng.random((300, 2)) * 640
    h = np.array([[1.01, 0.02, 30], [-0.01, 0.99, -12], [1e-4, -5e-5, 1]])
    b = matching._projected(h, a)
    b[:120] += 40 + rng.random((120, 2)) * 100
    got, inliers = matching.find_homography(a, b)
    assert np.allclose(got, h, atol=1e-6) and inliers == 180


def test_homography_of_too_few_or_equal_points(spark):
    assert matching.find_homography(np.zeros((3, 2)), np.zeros((3, 2))) == (None, 0)
    rows = [(1, 2, 0.0, 0.0, None, 1.0), (1, 2, 1.0, 0.0, float("nan"), 1.0), (1, 2, 1.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "src long, dst long, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in matching.consensus_homography(df).collect()] == [(1, 2, None, 0)]
    assert matching.consensus_homography(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, 2, 5.0, 5.0, 9.0, 9.0)] * 6, df.schema)
    assert matching.consensus_homography(same).count() == 1


def scale_rows(frame, level, scale, h, n=60, seed=5):
    """(frame, level, scale, kp, x, y, desc) of ``n`` points moved by ``h`` and then scaled; equal descriptors in every frame."""
    rng = np.random.default_rng(seed)
    at, desc = rng.random((n, 2)) * 640, rng.standard_normal((n, 16))
    at = matching._projected(np.array(h, float), at) * scale
    return [(frame, level, scale, k, *map(float, at[k]), desc[k].tolist()) for k in range(n)]


def test_scale_pair_search(spark):
    """Best scales by inliers, first of equals; rotated, stretched and empty pairs have none."""
    one = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    shift = [[1.02, 0.01, 40], [-0.01, 1.0, -25], [0, 0, 1]]
    turned = [[0.94, 0.34, 0], [-0.34, 0.94, 0], [0, 0, 1]]
    uneven = [[1.0, 0, 0], [0, 1.2, 0], [0, 0, 1]]
    rows = scale_rows(1, 0, 1.0, one) + scale_rows(1, 1, 0.5, one)
    weak = [(*r[:4], r[4] + (200 + 9 * r[3] if r[3] % 3 == 0 else 0), *r[5:]) for r in scale_rows(2, 0, 1.0, shift)]
    rows += weak + scale_rows(2, 3, 0.25, shift) + scale_rows(3, 0, 1.0, turned) + scale_rows(4, 0, 1.0, uneven) + scale_rows(5, 0, 1.0, one, n=3)
    k = spark.createDataFrame(rows, "frame long, level long, scale double, kp long, x double, y double, desc array<double>")
    pairs = spark.createDataFrame([(1, n) for n in (2, 3, 4, 5, 9)], "src long, dst long")
    got = matching.scale_pair_search(k, pairs).collect()
    assert [(r.src, r.dst, r.src_level, r.dst_level, r.inliers) for r in got] == [(1, 2, 0, 3, 60)]
    assert np.allclose(np.array(got[0].h).reshape(3, 3), shift, atol=1e-6) and got[0].error < 1e-6
    assert matching.scale_pair_search(k.limit(0), pairs).count() == 0


def test_names_and_transcripts(spark, tmp_path):
    (tmp_path / "names").write_bytes(b"a b\r\n\t\r\nc\r\n")
    assert [r.name for r in frames.read_names(spark, str(tmp_path / "names")).collect()] == ["ab", "c"]
    (tmp_path / "said").write_text("12\n\nhello 12\n  7 \nbye\n")
    assert [r.value for r in frames.read_transcript(spark, str(tmp_path / "said")).collect()] == ["hello 12", "bye"]


def test_written_times_are_read_again(spark, tmp_path):
    f = spark.range(20).select(F.col("id").alias("frame_idx"), (F.col("id") * 50).alias("ts_ms"))
    frames.write_timestamps(f, str(tmp_path / "t"))
    assert sorted(map(tuple, frames.read_timestamps(spark, str(tmp_path / "t")).collect())) == [(k, 50 * k) for k in range(20)]


def test_written_matrix_and_pairs(spark, tmp_path):
    m = spark.createDataFrame([(1, 2.5), (2, None)], "src long, `2` double")
    frames.write_matrix(m, str(tmp_path / "m"))
    back = spark.read.csv(str(tmp_path / "m"), sep=";", header=True, inferSchema=True)
    assert sorted(map(tuple, back.collect())) == [(1, 2.5), (2, None)]
    frames.write_pairs(m, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), sep="\t", header=True).count() == 2


def test_tiles_by_level(spark, tmp_path):
    t = spark.range(8).select((F.col("id") % 2).alias("component"), (F.col("id") % 3).alias("level"), F.col("id").alias("i"), F.col("id").alias("j"))
    slides.write_tiles(t, str(tmp_path / "tiles"))
    back = spark.read.parquet(str(tmp_path / "tiles"))
    assert back.filter("level = 1").count() == 3 and back.count() == 8


def test_growing_bounds(spark):
    f = spark.createDataFrame([(1, 0, 0, 10, 10), (1, 5, -2, 10, 10), (2, 1, 1, 1, 1)], "component long, x int, y int, w int, h int")
    assert sorted(map(tuple, stateful.bounds_stream(f).collect())) == [(1, 0, -2, 15, 10), (2, 1, 1, 2, 2)]


def _bridges(edges, inside, start, goal):
    """(cost, steps, path) of every simple path between two nodes."""
    out, todo = [], [(0.0, [start])]
    while todo:
        cost, path = todo.pop()
        if path[-1] == goal:
            out.append((cost, len(path) - 1, path))
            continue
        for a, b, penalty in edges:
            for v, w in ((a, b), (b, a)):
                if v == path[-1] and w not in path:
                    todo.append((cost + penalty + (w not in inside), [*path, w]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bridge_against_all_paths(spark, seed):
    rng = np.random.default_rng(seed)
    edges, members, want = [], [], {}
    for comp in range(8):
        e = [(int(a), int(b), float(p) / 2) for a, b, p in zip(rng.integers(0, 7, 11), rng.integers(0, 7, 11), rng.integers(0, 2, 11)) if a != b]
        inside = set(rng.integers(0, 7, 3).tolist())
        edges += [(comp, a, b, p, 0, 6) for a, b, p in e]
        members += [(comp, v) for v in inside]
        paths = _bridges(e, inside, 0, 6)
        if paths:
            cost, _, path = min(paths)
            want[comp] = (",".join(map(str, path)), cost)
    e = spark.createDataFrame(edges, "comp long, a long, b long, penalty double, s long, g long")
    m = spark.createDataFrame(members, "comp long, node long")
    assert {r.comp: (r.path, r.cost) for r in graph.bridge_path(e, m, "comp", "s", "g").collect()} == want
