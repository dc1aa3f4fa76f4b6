"""Pairs by place and by label: copies, crowded cells, and plans that don't gather a side on the driver."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from lumenfold.operators import frames, spatial
from lumenfold.plans.catalogue import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("round_view", [True, False])
def test_members_of_a_crowded_cell(spark, monkeypatch, round_view):
    """A cell over BLOCK members is dealt out; each pair comes once, and nothing is broadcast."""
    monkeypatch.setattr(spatial, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows = [(i, "a" if i % 3 else "b", float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-150, 150, (120, 2)))]
    out = spatial.member_overlaps(spark.createDataFrame(rows, "id long, brand string, x double, y double"), "brand", 60.0, round_view, 0.5, 100.0)
    assert "Broadcast" not in plan(out)

    def close(p, q):
        dx, dy = abs(p[2] - q[2]), abs(p[3] - q[3])
        return dx * dx + dy * dy < 2520 if round_view else dx < 45 and dy < 45

    want = sorted((p[1], p[0], q[0]) for p, q in itertools.combinations(rows, 2) if p[1] == q[1] and close(p, q))
    assert sorted(map(tuple, out.collect())) == want


@pytest.mark.parametrize("name", ["member_overlap_box", "member_overlap_round"])
def test_member_overlaps_broadcast_nothing(name, spark, data):
    assert "Broadcast" not in plan(QUERIES[name](spark, data))


@pytest.mark.parametrize("closed", [True, False])
def test_copies_of_boxes(spark, monkeypatch, closed):
    """Equal boxes are compared once, in lists of at most COPIES ids, and every pair of ids comes back."""
    monkeypatch.setattr(spatial, "BLOCK", 8)
    monkeypatch.setattr(spatial, "COPIES", 3)
    rng = np.random.default_rng(4)
    spots = [(float(x), float(y), 40.0, 30.0) for x, y in rng.integers(-10, 10, (12, 2)) * 10]
    rows = [(i, *spots[i % 12]) for i in range(96)]
    b = spark.createDataFrame(rows, "id long, x double, y double, w double, h double")
    assert spatial.overlap_classes(b, b, 50.0, closed=closed).count() <= (12 * 3) ** 2
    got = sorted((r.a_id, r.b_id) for r in spatial.overlap_join(b, b, 50.0, closed=closed).collect())

    def meet(p, q):
        gaps = (p[1] - q[1] - q[3], q[1] - p[1] - p[3], p[2] - q[2] - q[4], q[2] - p[2] - p[4])
        return max(gaps) <= 0 if closed else max(gaps) < 0

    assert got == sorted((p[0], q[0]) for p in rows for q in rows if meet(p, q))


@pytest.mark.parametrize("name", ["bbox_overlap", "frames_overlap"])
def test_pairs_of_boxes_are_not_joined_again(name, spark, data):
    """Brands come along with the boxes: above the join of cells no row of a pair is moved."""
    top = plan(QUERIES[name](spark, data)).split("Join")[0]
    assert "Generate explode(b_ids" in top and "Exchange" not in top


def test_cross_component_pairs_deal_one_label(spark):
    """The frames of a single label go to many tasks, whatever the bytes, and nothing is broadcast."""
    from pyspark.sql import functions as F

    f = spark.range(400).selectExpr("id AS frame", "if(id < 0, 'b', 'a') AS label", "id % 5 AS component")
    c = spark.range(10).selectExpr("id AS component", "if(id < 0, 'b', 'a') AS label", "id = 9 AS suspended")
    out = frames.cross_component_pairs(f, c)
    assert "Broadcast" not in plan(out)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert sorted(map(tuple, out.collect())) == [(i, t) for i in range(400) for t in range(9) if t != i % 5]
