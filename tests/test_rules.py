"""Closed-form cases of the rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import geometry as g
from lumenfold.functions import magnification as mag
from lumenfold.functions import text as t
from lumenfold.operators import aggregates, graph, matching, solve, spans, spatial, temporal, tiles, voting


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ratio_boundary(spark):
    n = spark.createDataFrame([(0, 1, 1, 5, 3.0, 6, 4.0), (0, 1, 2, 5, 2.9, 6, 4.0)], "src long, dst long, q long, t1 long, d1 double, t2 long, d2 double")
    assert [r.q for r in matching.ratio_matches(n, 0.75).collect()] == [2]


def test_one_neighbour_is_dropped(spark):
    k = spark.createDataFrame([(0, 1, 5), (0, 2, 9), (1, 3, 5)], "frame long, kp long, desc long")
    assert matching.knn2(k, matching.frame_pairs(spark.range(2).toDF("frame"), 1)).count() == 0


def test_mutual_matches_are_symmetric(spark):
    rng = np.random.default_rng(0)
    d = [int(x) for x in rng.integers(0, 2**62, 20)]
    k = [(0, i, d[i]) for i in range(20)] + [(1, 100 + i, d[i] ^ (1 << i % 5)) for i in range(20)]
    swapped = [(1 - f, kp, x) for f, kp, x in k]
    schema = "frame long, kp long, desc long"
    pairs = matching.frame_pairs(spark.range(2).toDF("frame"), 1)
    one = {(r.src_kp, r.dst_kp) for r in matching.mutual_matches(spark.createDataFrame(k, schema), pairs).collect()}
    two = {(r.dst_kp, r.src_kp) for r in matching.mutual_matches(spark.createDataFrame(swapped, schema), pairs).collect()}
    assert one == two and len(one) == 20


def test_quorum_stop(spark):
    e = spark.createDataFrame([(9, 10, 60), (8, 10, 45), (7, 10, 30)], "src long, dst long, inliers long")
    assert sorted(r.src for r in matching.backward_quorum(e, 100, 50).collect()) == [8, 9]
    only = spark.createDataFrame([(9, 10, 50)], "src long, dst long, inliers long")
    assert not matching.backward_quorum(only, 100, 50).first().ok


def test_vote_cluster_and_fallback(spark):
    schema = "grp long, vote_id long, x double, y double, inliers long"
    v = spark.createDataFrame([(1, 1, 0.0, 0.0, 20), (1, 2, 10.0, 0.0, 20), (1, 3, 20.0, 0.0, 20), (1, 4, 5000.0, 0.0, 59), (2, 5, 0.0, 0.0, 40), (2, 6, 9000.0, 0.0, 70)], schema)
    got = {r.grp: (r.vote_id, r.clustered) for r in voting.resolve_votes(v, 512.0).collect()}
    assert got == {1: (1, True), 2: (6, False)}


def test_position_truncates(spark):
    x, y = voting.position_from("a", "b", "tx", "ty")
    r = spark.createDataFrame([(100.0, 50.0, 7.0, -3.0), (1.0, -1.0, 0.5, 0.5)], "a double, b double, tx double, ty double").select(x.alias("x"), y.alias("y")).collect()
    assert [tuple(v) for v in r] == [(93, 53), (0, -1)]


def test_transforms_and_indexes(spark):
    one = spark.range(1).select(g.to_base(F.lit(2.0), F.lit(10.0), F.lit(0.5)).alias("x"), g.to_base(F.lit(4.0), F.lit(0.0), F.lit(0.5)).alias("y")).first()
    assert (one.x, one.y) == (6.0, 2.0)
    p = spark.createDataFrame([(-1,), (255,), (256,), (-256,)], "p int").select(g.tile_index_ref(F.col("p")).alias("r"), g.tile_index(F.col("p")).alias("f")).collect()
    assert [x.r for x in p] == [-1, 0, 1, -2] and [x.f for x in p] == [-1, 0, 1, -1]
    assert [r.v for r in spark.createDataFrame([(-4,), (-3,), (-1,), (3,)], "i int").select(g.parent_index(F.col("i")).alias("v")).collect()] == [-2, -2, -1, 1]


def test_coverage(spark):
    f = spark.createDataFrame([(1, 0.0, 0.0, 600.0, 600.0)], "id long, x double, y double, w double, h double")
    c = spatial.covered_tiles(f).collect()
    assert len(c) == 9 and {(r.i, r.j) for r in c if r.full} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_square_area(spark):
    sq = F.array(*[g.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    r = spark.range(1).select(g.area(sq).alias("a"), g.contains(sq, F.lit(5.0), F.lit(5.0)).alias("i"), g.contains(sq, F.lit(15.0), F.lit(5.0)).alias("o"), g.signed_area(g.clockwise(F.reverse(sq))).alias("s")).first()
    assert (r.a, r.i, r.o, r.s) == (100.0, True, False, 100.0)


def test_dark_dilation(spark):
    f = spark.range(10).withColumn("dark", F.col("id") == 5)
    assert [r.id for r in temporal.dilate_dark(f, "dark", "id").filter("not valid").orderBy("id").collect()] == [2, 3, 4, 5, 6, 7, 8]


def test_path_distance(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 6.0, 8.0), (2, 0, 0.0, 0.0), (2, 1, 3.0, 4.0)], "k long, i long, x double, y double")
    got = {r.k: (r.total, r.per_frame) for r in temporal.path_distance(p, ["k"], ["i"], "x", "y").collect()}
    assert got == {1: (10.0, 10.0), 2: (5.0, 0.0)}


def test_nav_paths(spark):
    f = spark.createDataFrame([(1, 0, "2x", 0), (1, 1, "2x", 0), (1, 2, None, -1), (1, 3, "4x", 0)], "s long, i long, mag string, comp int")
    got = temporal.navigation_paths(f.filter("comp >= 0"), "s", ["i"], "mag").collect()
    assert sorted((r.i, r.path) for r in got) == [(0, 1), (1, 1), (3, 2)]


def test_asof_and_clamp(spark):
    f = spark.createDataFrame([(1, 0, 0), (1, 1, 100), (1, 2, 200)], "k long, frame long, t long")
    q = spark.createDataFrame([(1, 1, 150, 160), (1, 2, -5, 999), (1, 3, 100, 100)], "k long, q long, t0 long, t1 long")
    got = {r.q: (r.first, r.last) for r in temporal.interval_to_frames(q, f, "k").collect()}
    assert got == {1: (1, 2), 2: (0, 2), 3: (1, 1)}


def test_final_position_fill(spark):
    f = spark.createDataFrame([(1, 0, "aligned", 10.0, 10.0, None, None, None), (1, 1, "bad", None, None, None, None, None), (1, 2, "unaligned", None, None, 0, 4.0, 0.0)], "k long, frame long, state string, x double, y double, matched_to long, rel_x double, rel_y double")
    got = {r.frame: (r.fx, r.fy, r.bad) for r in temporal.fill_positions(f, "k", ["frame"]).collect()}
    assert got == {0: (10.0, 10.0, False), 1: (10.0, 10.0, True), 2: (6.0, 10.0, False)}


def test_pause_comma(spark):
    w = spark.createDataFrame([(1, 0, "a", 0, 1000), (1, 1, "b", 3001, 3100), (1, 2, "c", 5100, 5200)], "k long, i long, w string, s long, e long")
    assert temporal.pause_punctuation(w, "k", ["i"], "w", "s", "e").first().text == "a, b c."


def test_tile_owner_rules(spark):
    def owner(o, c):
        d = spark.createDataFrame([(1, 0, *o), (1, 1, *c)], "tile long, frame long, motion double, focus double, d2 double")
        return tiles.tile_owner(d, ["tile"]).first().owner

    assert owner((200.0, 0.0, 0.0), (100.0, 0.0, 0.0)) == 1
    assert owner((10.0, 1000.0, 0.0), (20.0, 3000.0, 0.0)) == 1
    assert owner((10.0, 3000.0, 0.0), (20.0, 1000.0, 0.0)) == 0
    assert owner((10.0, 0.0, 30.0), (10.0, 0.0, 1.0)) == 1
    assert owner((10.0, 0.0, 20.0), (10.0, 0.0, 1.0)) == 0


def test_established_owner():
    c = tiles.Competition()
    for i in range(13):
        c.offer((i, 1), 5, 0, 0, 0)
    c.offer((0, 0), 4, 0, 0, 0)
    assert c.offer((0, 0), 5, 0, 0, 0) and c.owned[4] == 0


def test_evidence(spark):
    assert spans.resolve_spans("a b c b", ["b", "b"]) == [(1, 1), (3, 3)]
    assert spans.resolve_spans("No tumor, seen", ["tumor seen"]) == [(1, 2)]
    assert spans.resolve_spans("", ["x"]) == [(-1, -1)]


def test_assertion_order(spark):
    r = spark.createDataFrame([("Margin negative for tumor present",), ("present",), ("unclear",)], "x string").select(t.assertion(F.col("x")).alias("a")).collect()
    assert [x.a for x in r] == ["absent", "present", None]


def test_concept_merge_complements():
    c = pd.DataFrame([(1, 0, "3+4", "gleason_grade", "present", 3.0, 4.0, None, 2, 3, False), (1, 1, "20 %", "tumor_presence", "present", None, None, 20.0, -1, -1, True)], columns=["slide", "ord", "evidence", "kind", "assertion", "gleason_primary", "gleason_secondary", "percent_involvement", "first_word", "last_word", "is_global"])
    m = spans.merge_concepts(c)
    r = m.iloc[0]
    assert len(m) == 1 and r["percent_involvement"] == 20 and r["kind"] == "gleason_grade" and r["evidence"] == "3+4 | 20 %" and (r["first_word"], r["last_word"]) == (2, 3) and r["is_global"]


def test_rule_order(spark):
    r = spark.createDataFrame([("nonfocal",)], "x string").select(spans.classify_text(F.col("x"), [("nonfocal", "N"), ("focal", "F")]).alias("a"))
    assert r.first().a == "N"


def test_track_conflict(spark):
    m = spark.createDataFrame([(1, 2, 1, 1), (2, 1, 1, 2)], "src long, dst long, src_kp long, dst_kp long")
    got = graph.tracks(m).collect()
    assert len(got) == 3 and all(r.conflict for r in got)


def test_components_of_a_long_path_and_a_star(spark):
    e = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    c = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert set(c) == set(range(100, 161)) | set(range(500, 560)) and set(c.values()) == {100, 500}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        graph.tree_positions(spark.createDataFrame([(1, 2, 0), (2, 1, 0)], "frame long, matched_to long, x long"), ["x"]).collect()


def test_solver_against_least_squares(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 12, 80), rng.integers(12, 40, 80)
    off = rng.normal(size=80)
    x, norms = solve.conjugate_gradients(a, b, off, 40, 0, 200, 1e-18)
    m = np.zeros((80, 40))
    m[np.arange(80), b] += 1
    m[np.arange(80), a] -= 1
    want = np.zeros(40)
    want[1:] = np.linalg.lstsq(m[:, 1:], off, rcond=None)[0]
    assert np.linalg.norm(m @ x - off) <= np.linalg.norm(m @ want - off) + 1e-8
    assert norms[-1] <= norms[0]
    used = sorted({*a.tolist(), *b.tolist()})
    if 0 in used:
        eq = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "offset": off}))
        got = {r.node: r.x for r in solve.solve_distributed(eq, 0, 8).collect()}
        near, _ = solve.conjugate_gradients(a, b, off, 40, 0, 8)
        assert max(abs(got[n] - near[n]) for n in used) < 1e-6


def test_labels(spark):
    n = spark.createDataFrame([("12_04.Raw",), ("12.Raw",), ("12_33.Raw",)], "n string").select(mag.label_from_name(F.col("n")).alias("l")).collect()
    assert [r.l for r in n] == ["4x", None, None]
    assert spark.range(1).select(mag.slide_name(F.lit(27)).alias("s")).first().s == "2B"


def test_plurality_tie(spark):
    assert rows(aggregates.plurality(spark.createDataFrame([(1, "b"), (1, "a")], "k long, l string"), ["k"], "l"))[0][2] == "a"


def test_polygon_repair():
    from lumenfold.functions import polygons as p

    sq = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert p.clean([(0, 0), (0, 0), (5, 0), (10, 0), (10, 10), (0, 10)]) == sq
    assert p.clean([(0, 0), (1, 1), (2, 2)]) == [] and p.clean([]) == []
    assert p.signed_area(p.clean(sq[::-1])) > 0
    assert p.cross((0, 0), (2, 2), (0, 2), (2, 0)) and p.cross((0, 0), (2, 0), (2, 0), (3, 3)) and not p.cross((0, 0), (1, 0), (0, 1), (1, 1))
    notch = [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)]
    assert p.chord_is_legal(sq, 0, 2) and not p.chord_is_legal(notch, 2, 4) and not p.chord_is_legal(sq, 0, 1)
    assert p.insert_vertex(sq, (5, -1)) == [(0, 0), (5, -1), (10, 0), (10, 10), (0, 10)]
    assert p.largest([[(0, 0), (1, 0), (1, 1)], sq]) == sq
    a = {"x": 0, "y": 0, "angle": 355, "octave": 1, "desc": 7}
    assert p.same_feature(a, a | {"x": 2, "angle": 3}) and not p.same_feature(a, a | {"x": 4}) and not p.same_feature(a, a | {"octave": 2})


def test_refused_merge(spark):
    from lumenfold.operators import frames

    m = spark.createDataFrame([(0, 1, 2, 1, 1, 1.0), (0, 2, 1, 1, 2, 2.0), (0, 2, 3, 1, 1, 3.0)], "grp int, src long, dst long, src_kp long, dst_kp long, dist double")
    got = {(r.frame, r.kp): r.track for r in frames.refusing_tracks(m, "grp").collect()}
    assert got[1, 1] == got[2, 1] == got[3, 1] != got[1, 2]


def test_short_and_long_passages(spark):
    d = spark.createDataFrame([(1, "the quick  Brown fox jumps over it"), (2, None), (3, "")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "brown fox"), (2, "quick brown fox jumps over IT"), (3, "over the"), (4, ""), (5, None)], "item_id long, text string")
    assert rows(spans.evidence_exact(d, p)) == [(1, 1, 2, 3), (1, 2, 1, 6)]
    assert rows(spans.evidence_tokens(d, p)) == [(1, 1, 2, 3), (1, 2, 1, 6)]


@pytest.mark.parametrize("bound", [10_000, 0])
def test_short_and_long_evidence(spark, monkeypatch, bound):
    """Passages of one to seven words, whole and in parts of words, are found where a plain search finds them."""
    monkeypatch.setattr(spans, "SHORT", bound)
    texts = {1: "the quick brown fox jumps over the lazy dog again", 2: "a b c d e f g h", 3: "", 4: None, 5: "Größe ist über  alles\n groß", 6: "x", 7: "one two one two three"}
    needles = ["x", "own fo", "e", "b c d", "quick brown fox", "ick brown fox ju", "brown fox jumps over th", "quick brown fox jumps over the", "the quick brown fox jumps over the lazy", "two three", "e two th", "über alles", "ße ist üb", "nowhere", "", None, "dog again x"]
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    p = spark.createDataFrame(list(enumerate(needles)), "item_id long, text string")
    want = set()
    for i, text in texts.items():
        text = " ".join((text or "").lower().split())
        for k, n in enumerate(needles):
            if n and n in text:
                first = text[: text.index(n)].count(" ")
                want.add((i, k, first, first + n.count(" ")))
    got = [tuple(r) for r in spans.evidence_exact(d, p).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 15
    assert spans.evidence_exact(d, p.limit(0)).count() == 0
