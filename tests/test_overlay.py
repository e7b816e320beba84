"""Polygon overlay against counts of small squares, and areas against each other."""

import numpy as np
import pytest

from wayglass.operators import overlay as ov


def l_shape(x, y, w, h, nx, ny):
    """A rectangle without its upper right corner of nx by ny, and the unit squares that it covers."""
    ring = [[x, y], [x + w, y], [x + w, y + h - ny], [x + w - nx, y + h - ny], [x + w - nx, y + h], [x, y + h]]
    return ring, {(i, j) for i in range(x, x + w) for j in range(y, y + h) if not (i >= x + w - nx and j >= y + h - ny)}


def world(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        w, h = rng.integers(2, 9, 2)
        out.append(l_shape(*map(int, (*rng.integers(0, 20, 2), w, h, rng.integers(1, w), rng.integers(1, h)))))
    return out


RINGS = "key string, shape string, side int, ring array<array<double>>"


@pytest.mark.parametrize("cell,most", [(7.3, 400), (100.0, 12), (2.2, 30)])
def test_areas_and_boundaries_of_unit_squares(spark, cell, most):
    shapes = world(1, 14)
    floats = lambda r: [[float(a) for a in p] for p in r]
    rows = [("k", f"s{i}", int(i >= 9), floats(r if i % 2 else r[::-1])) for i, (r, _) in enumerate(shapes)]
    rows += [("hole", "h", 0, floats([[0, 0], [9, 0], [9, 9], [0, 9]])), ("hole", "h", 0, floats([[2, 2], [5, 2], [5, 5], [2, 5]])), ("hole", "bad", 0, [[0.0, 0.0], [1.0, 1.0]]), ("hole", "worse", 0, [[0.0, 0.0], [float("nan"), 1.0], [1.0, 2.0]]), ("none", "x", 0, None)]
    pieces = ov.cut_rings(spark.createDataFrame(rows, RINGS).repartition(3), cell).cache()
    first, second = [set.union(*(c for _, c in part)) for part in (shapes[:9], shapes[9:])]
    got = {(r["key"], r["shape"]): (r["area"], r["beyond"]) for r in ov.areas(pieces, cell, most).collect()}
    want = {("k", f"s{i}"): (len(c), len(c - second)) for i, (_, c) in enumerate(shapes[:9])}
    want |= {("k", None): (len(first), len(first - second)), ("hole", "h"): (72, 72), ("hole", None): (72, 72)}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6), k

    left = first - second
    sides = {((i + dx, j + dy), (i + ex, j + ey)) for i, j in left for dx, dy, ex, ey, ni, nj in ((0, 0, 1, 0, 0, -1), (1, 0, 1, 1, 1, 0), (1, 1, 0, 1, 0, 1), (0, 1, 0, 0, -1, 0)) if (i + ni, j + nj) not in left}
    segments = ov.boundary(pieces, cell, most)
    lengths = {r["key"]: 0.0 for r in segments.collect()}
    for r in segments.collect():
        lengths[r["key"]] += abs(r["x1"] - r["x0"]) + abs(r["y1"] - r["y0"])
    assert lengths["k"] == pytest.approx(len(sides), abs=1e-6) and lengths["hole"] == pytest.approx(36 + 12, abs=1e-6)

    if most != 400:
        return
    rings = {}
    for r in ov.rings_of(segments).collect():
        p = np.array(r["ring"])
        q = np.roll(p, -1, 0)
        rings.setdefault(r["key"], []).append(float((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum() / 2))
    assert sum(rings["k"]) == pytest.approx(len(left), abs=1e-5)
    assert sorted(rings["hole"]) == pytest.approx([-9, 81], abs=1e-6)  # outside counter-clockwise, the hole clockwise


def test_slanted_polygons_by_inclusion_and_exclusion(spark):
    rng = np.random.default_rng(3)
    star = lambda cx, cy: [[float(cx + r * np.cos(a)), float(cy + r * np.sin(a))] for a, r in zip(np.sort(rng.random(24)) * 2 * np.pi, 1 + 2 * rng.random(24))]
    a, b = star(0, 0), star(1.5, 0.7)
    rows = [("union", "a", 0, a), ("union", "b", 0, b), ("a-b", "a", 0, a), ("a-b", "b", 1, b), ("b-a", "b", 0, b), ("b-a", "a", 1, a), ("twice", "a", 0, a), ("twice", "again", 0, a[::-1])]
    got = {(r["key"], r["shape"]): (r["area"], r["beyond"]) for r in ov.areas(ov.cut_rings(spark.createDataFrame(rows, RINGS), 0.9), 0.9).collect()}
    shoelace = lambda p: abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1]))) / 2
    assert got["union", "a"][0] == pytest.approx(shoelace(a), abs=1e-6) and got["union", "b"][0] == pytest.approx(shoelace(b), abs=1e-6)
    union, ab, ba = got["union", None][0], got["a-b", "a"][1], got["b-a", "b"][1]
    both = shoelace(a) - ab
    assert union == pytest.approx(shoelace(a) + shoelace(b) - both, abs=1e-6) and both == pytest.approx(shoelace(b) - ba, abs=1e-6)
    assert got["twice", None][0] == pytest.approx(shoelace(a), abs=1e-6)


def test_margin_and_simplification(spark):
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]
    rings = ov.buffered(spark.createDataFrame([("k", "s", 0, square)], RINGS), 0.5, 8)
    pieces = ov.cut_rings(rings, 1.7)
    area = {r["shape"]: r["area"] for r in ov.areas(pieces, 1.7).collect()}[None]
    assert area == pytest.approx(16 + 4 * 4 * 0.5 + 4 * np.sin(np.pi / 4) * 0.25, abs=1e-5)
    out = ov.rings_of(ov.boundary(pieces, 1.7)).collect()
    assert len(out) == 1 and 12 <= len(out[0]["ring"]) <= 20 and 4 <= len(ov.simplified(out[0]["ring"], 0.3)) <= 8
    assert ov.simplified([*square, [-0.001, 2.0]], 0.01) == square


def test_no_shapes(spark):
    pieces = ov.cut_rings(spark.createDataFrame([], RINGS), 1.0)
    assert ov.areas(pieces, 1.0).count() == 0 and ov.rings_of(ov.boundary(pieces, 1.0)).count() == 0
