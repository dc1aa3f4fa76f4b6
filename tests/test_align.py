"""The alignment of a batch against a plane of known keypoints."""

from __future__ import annotations

import numpy as np
import pytest

from lumenfold.operators import align


@pytest.fixture(scope="module")
def plane(spark):
    """60 tracks on a plane, seen by four known frames, and by frames 10 (with a winner) and 11 (without)."""
    rng = np.random.default_rng(2)
    xy, desc = rng.integers(0, 400, (60, 2)).astype(float), rng.normal(size=(60, 64))  # far apart: no two pass the ratio test by chance
    frames = {1: (0, 0), 2: (100, 0), 3: (0, 150), 4: (190, 190), 10: (40, 30), 11: (150, 120)}
    see = {f: [t for t in range(60) if 0 <= xy[t][0] - x <= 200 and 0 <= xy[t][1] - y <= 200] for f, (x, y) in frames.items()}
    keypoints = [(f, t, float(xy[t][0] - x), float(xy[t][1] - y), desc[t].tolist()) for f, (x, y) in frames.items() for t in see[f]]
    kp = spark.createDataFrame(keypoints, "frame long, kp long, x double, y double, desc array<double>")
    observed = spark.createDataFrame([(t, f, t) for f in (1, 2, 3, 4) for t in see[f]], "track long, frame long, kp long")
    places = spark.createDataFrame([(t, float(xy[t][0]), float(xy[t][1]), t != 5, True) for t in range(60)], "track long, x double, y double, live boolean, solved boolean")
    images = spark.createDataFrame([(10, 0.0, 0.0, 200.0, 200.0), (11, 100.0, 100.0, 200.0, 200.0)], "frame long, x double, y double, w double, h double")
    wins = spark.createDataFrame([(1, 10, t, t) for t in see[10] if t in see[1]], "src long, dst long, src_kp long, dst_kp long")
    return images, wins, kp, observed, places, xy, see


def greedy(frame, box, most, see, xy, done):
    open_ = {t for t in range(60) if t != 5 and box[0] <= xy[t][0] <= box[0] + box[2] and box[1] <= xy[t][1] <= box[1] + box[2]}
    for f in done:
        open_ -= set(see[f])
    out, left = [], [f for f in (1, 2, 3, 4) if f not in done]
    for turn in range(1, most + 1):
        best = min(left, key=lambda f: (-len(open_ & set(see[f])), f), default=None)
        if best is None or not open_ & set(see[best]):
            break
        out.append((frame, turn, best, len(open_ & set(see[best]))))
        open_ -= set(see[best])
        left.remove(best)
    return out


def test_batch(spark, plane):
    images, wins, kp, observed, places, xy, see = plane
    got = align.align_batch(images, wins, kp, observed, places)
    boxes = {r.q: (r.x, r.y, r.w, r.h, r.valid) for r in got.positions.collect()}
    assert boxes[10] == pytest.approx((40, 30, 200, 200, True)) and boxes[11] == (0, 0, 400, 400, False)
    chosen = sorted((r.frame, r.turn, r.item, r.gain) for r in got.candidates.collect())
    assert chosen == greedy(10, (40, 30, 200), 4, see, xy, [1]) + greedy(11, (0, 0, 400), 6, see, xy, [])
    rows = {(r.frame, r.kp): (r.track, r.conflict) for r in got.observed.collect()}
    # every keypoint of one track has one name, and none of two; a new frame's join where a matched frame sees them
    names = {}
    for (_, k), (track, conflict) in rows.items():
        assert not conflict and names.setdefault(k, track) == track
    assert len(set(names.values())) == len(names)
    for f, matched in ((10, [1] + [c[2] for c in chosen if c[0] == 10]), (11, [c[2] for c in chosen if c[0] == 11])):
        want = {t for t in see[f] if any(t in see[m] for m in matched)}
        assert {k for g, k in rows if g == f} == want


def test_nothing_new(spark, plane):
    images, wins, kp, observed, places, *_ = plane
    got = align.align_batch(images.limit(0), wins.limit(0), kp, observed, places)
    assert got.positions.count() == 0 and got.candidates.count() == 0
    assert {(r.frame, r.kp) for r in got.observed.collect()} == {(r.frame, r.kp) for r in observed.collect()}


def test_anchor_components(spark):
    """A new component by features of the last frame, by those of another magnification, by velocity, by label, and not at all."""
    from lumenfold.operators import anchor

    from .test_kernels import scale_rows

    one, shift = [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [[1, 0, 30], [0, 1, -20], [0, 0, 1]]
    half = [[0.5, 0, 100], [0, 0.5, 80], [0, 0, 1]]
    frame = "slide long, frame long, component long, x double, y double, mpp double, observed boolean, scale double"
    resolved = [(s, f, 7, 100.0 * f, 10.0, 1.0, s != 5, 2.0) for s in (1, 2, 3, 4, 5) for f in (10 * s, 10 * s + 2)]
    roots = [(1, 13, 100, 1.0, True, 400.0, 300.0), (2, 23, 101, 0.5, False, 400.0, 300.0), (3, 33, 102, 1.0, True, 400.0, 300.0), (4, 43, 103, 0.5, True, 400.0, 300.0), (5, 53, 104, 0.5, True, 400.0, 300.0), (6, 63, 105, 0.5, True, 400.0, 300.0)]
    keys = scale_rows(12, 0, 0.5, one) + scale_rows(13, 0, 1.0, shift) + scale_rows(23, 0, 1.0, one) + scale_rows(22, 0, 1.0, half)
    a = spark.createDataFrame(roots, "slide long, frame long, component long, mpp double, observed boolean, w double, h double")
    b = spark.createDataFrame(resolved, frame)
    k = spark.createDataFrame(keys, "frame long, level long, scale double, kp long, x double, y double, desc array<double>")
    got = {r.component: (r.landmark, r.how, *[None if v is None else round(v, 4) for v in (r.scale, r.x, r.y)]) for r in anchor.anchor_components(a, b, k, [0.5, 1.0]).collect()}
    assert got == {
        100: (12, "features", 2.0, 1170.0, 30.0),
        101: (22, "features", 1.0, 2300.0, 90.0),
        102: (32, "velocity", 2.0, 3300.0, 10.0),
        103: (42, "label", 1.0, 4300.0, 85.0),
        104: (None, None, None, None, None),
    }
    assert anchor.anchor_components(a, b.limit(0), k, [1.0]).count() == 0 and anchor.anchor_components(a.limit(0), b, k, [1.0]).count() == 0


def test_most_shared_is_the_brute_force_choice():
    """Crowded, sparse and far places, equal areas, frames on one place, roots of several sizes."""
    from lumenfold.operators.anchor import TARGETS, most_shared

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 60, 900), rng.uniform(0, 3000, 300), np.full(3, 7)]).astype(float)
    y = np.concatenate([rng.integers(0, 40, 900), rng.uniform(0, 1000, 300), np.full(3, 9)]).astype(float)
    frame = rng.permutation(len(x)).astype(np.int64)
    px, py = rng.uniform(-500, 3500, 400).round(), rng.uniform(-400, 1400, 400).round()
    px[:150], py[:150] = rng.integers(-20, 80, 150), rng.integers(-20, 60, 150)
    w, h = rng.choice([40.0, 400.0], 400), rng.choice([30.0, 300.0], 400)
    last = rng.choice(frame, 400)
    got: dict = {}
    for r, f, area in zip(*most_shared(px, py, w, h, last, x, y, frame, 400.0, 300.0)):
        got.setdefault(int(r), []).append((-area, int(frame[f])))
    for i in range(400):
        dx, dy = np.abs(x - px[i]), np.abs(y - py[i])
        ok = (dx < w[i]) & (dy < h[i]) & (frame != last[i])
        want = sorted(zip((-(w[i] - dx) * (h[i] - dy))[ok], frame[ok].tolist()))[: TARGETS - 1]
        assert sorted(got.get(i, [])) == want


def test_anchor_targets_dont_pair_a_component_with_itself(spark):
    """Frames of one component meet its roots by place; a resolved frame of a root's own number isn't before it."""
    from lumenfold.operators import anchor

    n = 20_000
    resolved = spark.range(n).selectExpr("1 AS slide", "id AS frame", "0L AS component", "cast(id % 200 * 90 AS double) AS x", "cast(id div 200 * 70 AS double) AS y", "1.0D AS mpp", "true AS observed", "1.0D AS scale")
    roots = spark.range(1, n, 2).selectExpr("1 AS slide", "id AS frame", "id + 100000 AS component", "1.0D AS mpp", "true AS observed", "100.0D AS w", "80.0D AS h")
    out = anchor.anchor_targets(roots, resolved)
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    rows = out.filter("turn = 0").collect()
    assert len(rows) == n // 2 and all(r.src == r.component - 100001 for r in rows)
    assert out.groupBy("turn").count().orderBy("turn").collect() == [(0, n // 2), (1, n // 2 - 99), (2, n // 2 - 99)]  # the first root of a row is projected beyond the others


def test_component_anchor_doesnt_pair_a_component_with_itself(spark, data):
    """Both uses of the targets look frames up by place."""
    from lumenfold.plans.catalogue import QUERIES

    plan = QUERIES["component_anchor"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "< 400.0" not in plan


def test_component_anchor_moves_its_frames_once(spark, data):
    """Targets are found once, and all that needs the last resolved frames reads one exchange of them."""
    from lumenfold.plans.catalogue import QUERIES

    out = QUERIES["component_anchor"](spark, data)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
    out.collect()
    ran = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    plain = [x for x in ran.splitlines() if "Exchange hashpartitioning(slide#" in x and "Reused" not in x]
    assert len([x for x in plain if x.split("hashpartitioning(")[1].split(")")[0].count("#") == 1]) == 1
    assert "ReusedExchange" in ran and "SortMergeJoin" not in ran


def test_anchor_targets_of_crowded_tiles_and_of_no_slide(spark, monkeypatch):
    """A dealt-out tile gives the same targets; frames of no slide or number precede nothing; tiles without roots do no harm."""
    from lumenfold.operators import anchor

    n = 3000
    resolved = spark.range(n).selectExpr("id % 2 AS slide", "id AS frame", "id % 3 AS component", "cast(id * 37 % 500 AS double) AS x", "cast(id * 91 % 700 AS double) AS y", "1.0D AS mpp", "true AS observed", "1.0D AS scale")
    roots = spark.range(1, n, 5).selectExpr("id % 2 AS slide", "id AS frame", "id + 100000 AS component", "if(id % 4 = 0, 0.5D, 1.0D) AS mpp", "true AS observed", "60.0D AS w", "80.0D AS h")
    rows = lambda: sorted(map(tuple, anchor.anchor_targets(roots, resolved).collect()))
    want = rows()
    assert {r[2] for r in want} == {0, 1, 2}
    monkeypatch.setattr(anchor, "ROOTS", 3)
    assert rows() == want
    lost = resolved.selectExpr("cast(null AS bigint) AS slide", "frame", "component", "x", "y", "mpp", "observed", "scale").union(resolved.selectExpr("slide", "cast(null AS bigint)", "component", "x", "y", "mpp", "observed", "scale"))
    resolved, roots = resolved.union(lost), roots.union(roots.selectExpr("cast(null AS bigint)", "frame", "component", "mpp", "observed", "w", "h"))
    assert rows() == want
    roots = roots.filter("frame = 2991")
    assert rows() == [r for r in want if r[1] == 102991]


def test_anchor_targets_as_far_off_on_either_side(spark):
    """49 in 49 frames is 1 a frame, not 49 * (1 / 49): the smaller of two frames at half a step comes first."""
    from lumenfold.operators import anchor

    frames = [(1, f, 0, x, 0.0, 1.0, True, 1.0) for f, x in ((3, 1.5), (5, 0.5), (100, -49.0), (149, 0.0))]
    resolved = spark.createDataFrame(frames, "slide long, frame long, component long, x double, y double, mpp double, observed boolean, scale double")
    roots = spark.createDataFrame([(1, 150, 9, 1.0, True, 1.0, 1.0)], "slide long, frame long, component long, mpp double, observed boolean, w double, h double")
    assert [(r.turn, r.src) for r in anchor.anchor_targets(roots, resolved).orderBy("turn").collect()] == [(0, 149), (1, 3), (2, 5)]
