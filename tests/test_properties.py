"""Properties that hold for any input."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.functions import pixels as px
from lumenfold.functions import polygons as pg
from lumenfold.operators import solve, spans
from lumenfold.operators.tiles import Competition

point = st.tuples(st.integers(-50, 50), st.integers(-50, 50))


@given(st.lists(point, max_size=12))
def test_cleaning_is_idempotent_and_keeps_the_area(p):
    c = pg.clean([(float(x), float(y)) for x, y in p])
    assert pg.clean(c) == c and (not c or pg.signed_area(c) >= 0)


@given(point, point, point, point)
def test_crossing_is_symmetric(a, b, c, d):
    assert pg.cross(a, b, c, d) == pg.cross(c, d, a, b) == pg.cross(b, a, c, d)


@given(st.integers(1, 90), st.integers(1, 90), st.integers(4, 40))
@settings(max_examples=25, deadline=None)
def test_tiles_cover_the_image(h, w, size):
    img = np.arange(h * w, dtype=np.int64).reshape(h, w).astype(np.uint8)
    assert (px.assemble(px.cut_tiles(img, size), size)[:h, :w] == img).all()


@given(st.text("ab c.,", max_size=30), st.lists(st.text("ab c.,", max_size=6), max_size=4))
def test_spans_lie_in_the_text(text, wanted):
    n = len(text.split(" "))
    for first, last in spans.resolve_spans(text, wanted):
        assert (first, last) == (-1, -1) or 0 <= first <= last <= n


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 200), st.integers(0, 4000), st.integers(0, 60)), max_size=40))
def test_owned_counts_add_up(offers):
    c = Competition()
    for tile, frame, motion, focus, d2 in offers:
        c.offer((tile, 0), frame, motion, focus, d2)
    assert sum(c.owned.values()) == len(c.owner) and all(v >= 0 for v in c.owned.values())


@given(st.integers(2, 8), st.data())
@settings(max_examples=30, deadline=None)
def test_solver_recovers_consistent_positions(n, data):
    x = np.array([0.0, *[data.draw(st.integers(-100, 100)) for _ in range(n - 1)]])
    a = np.array([data.draw(st.integers(0, k)) for k in range(n - 1)])
    b = np.arange(1, n)
    got, norms = solve.conjugate_gradients(a, b, x[b] - x[a], n, 0, 200, 1e-20)
    assert np.allclose(got, x, atol=1e-5)


@pytest.mark.parametrize("local", [200_000, 10])
def test_components_by_task_and_by_rounds(spark, monkeypatch, local):
    """Contracted in one task or by rounds, components are those of a plain search; nodes may be strings."""
    from lumenfold.operators import graph

    monkeypatch.setattr(graph, "LOCAL", local)
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    root = {x: x for p in pairs for x in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: y for x, y in root.items() if any(x in p and p[0] != p[1] for p in pairs)}
    for kind, as_ in (("long", int), ("string", lambda x: f"n{x:04d}")):
        df = spark.createDataFrame([(as_(a), as_(b)) for a, b in pairs], f"src {kind}, dst {kind}").repartition(8)
        got = {x.node: x.component for x in graph.connected_components(df).collect()}
        assert got == {as_(x): as_(y) for x, y in want.items()}
