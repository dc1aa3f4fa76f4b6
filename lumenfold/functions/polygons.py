"""Polygon repair and editing on lists of (x, y), to be run inside Arrow-fed UDFs."""

from __future__ import annotations

Point = tuple[float, float]


def signed_area(p: list[Point]) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1])) / 2


def _turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def clean(p: list[Point], eps: float = 1e-9) -> list[Point]:
    """Without repeated and collinear points, clockwise (y down). Fewer than three points left give none."""
    out = [q for k, q in enumerate(p) if q != p[k - 1] or len(p) == 1]
    changed = True
    while changed and len(out) >= 3:
        kept = [q for k, q in enumerate(out) if abs(_turn(out[k - 1], q, out[(k + 1) % len(out)])) > eps]
        changed, out = len(kept) != len(out), kept
    if len(out) < 3:
        return []
    return out[::-1] if signed_area(out) < 0 else out


def cross(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two segments share a point, ends included."""
    t = [_turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)]
    if (t[0] > 0) != (t[1] > 0) and (t[2] > 0) != (t[3] > 0) and all(t):
        return True
    on = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    return any(v == 0 and on(*s) for v, s in zip(t, ((a, b, c), (a, b, d), (c, d, a), (c, d, b))))


def inside(p: list[Point], x: float, y: float) -> bool:
    out = False
    for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            out = not out
    return out


def chord_is_legal(p: list[Point], i: int, j: int) -> bool:
    """Whether the chord between two vertices stays inside: it meets no edge but at its ends, and its middle is in."""
    n = len(p)
    if (i - j) % n in (0, 1, n - 1):
        return False
    for k in range(n):
        if len({k, (k + 1) % n} & {i, j}) == 0 and cross(p[i], p[j], p[k], p[(k + 1) % n]):
            return False
    return inside(p, (p[i][0] + p[j][0]) / 2, (p[i][1] + p[j][1]) / 2)


def insert_vertex(p: list[Point], q: Point) -> list[Point]:
    """``q`` put into the edge it is nearest; of edges equally near, the one onto whose inside it projects, then the first."""

    def rank(k: int) -> tuple[float, bool, int]:
        (x1, y1), (x2, y2) = p[k], p[(k + 1) % len(p)]
        dx, dy = x2 - x1, y2 - y1
        n = dx * dx + dy * dy
        t = ((q[0] - x1) * dx + (q[1] - y1) * dy) / n if n else 0.0
        u = min(max(t, 0.0), 1.0)
        return (round((q[0] - x1 - u * dx) ** 2 + (q[1] - y1 - u * dy) ** 2, 9), not 0 < t < 1, k)

    k = min(range(len(p)), key=rank)
    return [*p[: k + 1], q, *p[k + 1 :]]


def largest(rings: list[list[Point]]) -> list[Point]:
    """Ring of the largest area, the first on ties."""
    return max(rings, key=lambda r: abs(signed_area(r)), default=[])


def same_feature(a: dict, b: dict) -> bool:
    """Whether two keypoints are one: within 3 px and 10 degrees, same octave, under 20 differing bits."""
    turn = abs(a["angle"] - b["angle"]) % 360
    near = (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 <= 9
    return near and min(turn, 360 - turn) <= 10 and a["octave"] == b["octave"] and (a["desc"] ^ b["desc"]).bit_count() < 20
