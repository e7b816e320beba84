"""Union and difference of any number of polygons, as areas and as boundaries, over a grid of cells.

Shapes are rows of rings (key, shape, side, ring): a point is inside a shape if it is inside an odd number of its rings, so holes are rings like others, in either
direction. Rings are first cut along the grid, halving the grid each time, so that a task never holds all shapes of a key, only what lies in one cell;
a cell that holds more than `most` edges within its border is cut in four, again and again.

In a cell all edges are cut where they meet or touch. Just beside the middle of each piece both sides are tested against every shape: a piece is boundary of the
result where one side is inside it and the other isn't, and is directed with the inside on its left. Areas are sums over pieces, the cell's own border included;
the boundary is what lies within the cells, joined to rings by its ends.

Coordinates are rounded to 9 decimals, so slivers thinner than that are lost; an edge that runs along a grid line for its whole length would count as
border, so the grid's origin is off any coordinate that borders are drawn along. Rings of fewer than three points, or with null or non-finite coordinates, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayglass.functions.polygons import DEGREE_KM
from wayglass.plans.iterate import component_labels, cut

#: The grid's origin.
ORIGIN = (-0.01370731, -0.02710957)
DIGITS = 9
#: How far beside a piece its sides are tested.
BESIDE = 4e-9
MOST = 400
PIECES = "key string, cx long, cy long, shape string, side int, xs array<double>, ys array<double>"
Box = tuple[float, float, float, float]


def half(ring: np.ndarray, axis: int, limit: float, below: bool) -> np.ndarray:
    """The part of a ring on one side of a line. A crossing is worked out from the edge's lower end, so that both sides and both directions agree on it."""
    if not len(ring):
        return ring
    v = ring[:, axis]
    inside = v <= limit if below else v >= limit
    if inside.all():
        return ring
    if not inside.any():
        return ring[:0]
    nxt, inn = np.roll(ring, -1, 0), np.roll(inside, -1)
    swap = nxt[:, axis] < ring[:, axis]
    lo, hi = np.where(swap[:, None], nxt, ring), np.where(swap[:, None], ring, nxt)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = lo + ((limit - lo[:, axis]) / (hi[:, axis] - lo[:, axis]))[:, None] * (hi - lo)
    cross = np.round(cross, DIGITS)
    cross[:, axis] = limit
    out = np.empty((2 * len(ring), 2))
    out[0::2], out[1::2] = ring, cross
    keep = np.empty(2 * len(ring), bool)
    keep[0::2], keep[1::2] = inside, inside != inn
    return out[keep]


def within(ring: np.ndarray, box: Box) -> np.ndarray:
    for axis, limit, below in ((0, box[0], False), (0, box[2], True), (1, box[1], False), (1, box[3], True)):
        ring = half(ring, axis, limit, below)
    return ring


def by_cells(ring: np.ndarray, cell: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(cx, cy, part) of a ring for every cell that it reaches into, by halving the range of cells."""

    def spread(part: np.ndarray, axis: int, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
        if len(part) < 3:
            return
        if lo == hi:
            yield lo, part
            return
        middle = (lo + hi + 1) // 2
        line = round(ORIGIN[axis] + middle * cell, DIGITS)
        yield from spread(half(part, axis, line, True), axis, lo, middle - 1)
        yield from spread(half(part, axis, line, False), axis, middle, hi)

    span = lambda part, axis: (int(np.floor((part[:, axis].min() - ORIGIN[axis]) / cell)), int(np.floor((part[:, axis].max() - ORIGIN[axis]) / cell)))
    for cx, column in spread(ring, 0, *span(ring, 0)):
        for cy, part in spread(column, 1, *span(column, 1)):
            yield cx, cy, part


def cut_rings(rings: DataFrame, cell: float) -> DataFrame:
    """PIECES of rings (key, shape, side, ring as an array of (x, y) arrays; optionally box, an array of west, south, east, north that the ring is cut to)."""
    boxed = "box" in rings.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, shape, side, ring, *box in zip(b["key"], b["shape"], b["side"], b["ring"], *([b["box"]] if boxed else []), strict=True):
                if ring is None or len(ring) < 3 or any(p is None or len(p) < 2 or p[0] is None or p[1] is None for p in ring):
                    continue
                points = np.round(np.array([[p[0], p[1]] for p in ring], float), DIGITS)
                if not np.isfinite(points).all():
                    continue
                if box:
                    points = within(points, tuple(np.round(np.array(box[0], float), DIGITS)))
                    if len(points) < 3:
                        continue
                out += [(key, cx, cy, shape, side, part[:, 0], part[:, 1]) for cx, cy, part in by_cells(points, cell)]
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
                    out = []
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return rings.select("key", "shape", "side", "ring", *(["box"] if boxed else [])).mapInPandas(work, PIECES)


def meeting(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (from, to) of edges p-q, cut where they meet or touch each other, each once in one direction."""
    n = len(p)
    d = q - p
    rx, ry = p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1]
    det = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    size = np.hypot(d[:, 0], d[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (d[None, :, 0] * ry - d[None, :, 1] * rx) / det
        u = (d[:, None, 0] * ry - d[:, None, 1] * rx) / det
    hit = (np.abs(det) > 1e-12 * size[:, None] * size[None, :]) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    e, f = np.nonzero(hit)
    ends = [(np.arange(n), np.zeros(n)), (np.arange(n), np.ones(n)), (e, t[e, f])]
    for end in (p, q):  # ends of others that lie on an edge
        vx, vy = end[None, :, 0] - p[:, None, 0], end[None, :, 1] - p[:, None, 1]
        along = (vx * d[:, None, 0] + vy * d[:, None, 1]) / (size**2)[:, None]
        off = np.abs(vx * d[:, None, 1] - vy * d[:, None, 0]) / size[:, None]
        e, f = np.nonzero((off < 2e-9) & (along > 0) & (along < 1))
        ends.append((e, along[e, f]))
    edge, at = np.concatenate([x[0] for x in ends]), np.concatenate([x[1] for x in ends])
    order = np.lexsort((at, edge))
    edge, at = edge[order], at[order]
    points = np.round(p[edge] + at[:, None] * d[edge], DIGITS)
    same = edge[1:] == edge[:-1]
    a, b = points[:-1][same], points[1:][same]
    swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
    pieces = np.unique(np.concatenate([a, b], 1), axis=0)
    pieces = pieces[(pieces[:, :2] != pieces[:, 2:]).any(1)]
    return pieces[:, :2], pieces[:, 2:]


def insides(points: np.ndarray, p: np.ndarray, q: np.ndarray, shape: np.ndarray, n_shapes: int) -> np.ndarray:
    """(points, shapes): which points are inside which shapes."""
    out = np.zeros((len(points), n_shapes), bool)
    of = np.zeros((len(p), n_shapes), np.int32)
    of[np.arange(len(p)), shape] = 1
    for at in range(0, len(points), 2048):
        x, y = points[at : at + 2048, :1], points[at : at + 2048, 1:]
        above = p[None, :, 1] > y
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = (above != (q[None, :, 1] > y)) & (x < p[None, :, 0] + (y - p[None, :, 1]) / (q[None, :, 1] - p[None, :, 1]) * (q[None, :, 0] - p[None, :, 0]))
        out[at : at + 2048] = (cross.astype(np.int32) @ of) % 2 == 1
    return out


def inner_edges(rings: list[tuple[int, np.ndarray]], box: Box) -> int:
    """How many edges don't lie on the box's border."""
    n = 0
    for _, r in rings:
        nxt = np.roll(r, -1, 0)
        border = [(r[:, c] == nxt[:, c]) & ((r[:, c] == box[c]) | (r[:, c] == box[c + 2])) for c in (0, 1)]
        n += int((~(border[0] | border[1])).sum())
    return n


def solve_cell(rings: list[tuple[int, np.ndarray]], n_shapes: int, box: Box, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, inside left, inside right) of all pieces in a cell, the last two by shapes. Several results if the cell has to be cut; each has its own border."""
    count = inner_edges(rings, box)
    if count > most:
        mx, my = round((box[0] + box[2]) / 2 + 1.3e-7, DIGITS), round((box[1] + box[3]) / 2 + 1.7e-7, DIGITS)
        quarters = [(box[0], box[1], mx, my), (mx, box[1], box[2], my), (box[0], my, mx, box[3]), (mx, my, box[2], box[3])]
        parts = [[(s, r) for s, r in ((s, within(r, quarter)) for s, r in rings) if len(r) >= 3] for quarter in quarters]
        if max(inner_edges(part, quarter) for part, quarter in zip(parts, quarters, strict=True)) <= 0.7 * count:  # else all meet in one place, which no cut parts
            for part, quarter in zip(parts, quarters, strict=True):
                yield from solve_cell(part, n_shapes, quarter, most)
            return
    if not rings:
        return
    p, q = np.concatenate([r for _, r in rings]), np.concatenate([np.roll(r, -1, 0) for _, r in rings])
    shape = np.repeat([s for s, _ in rings], [len(r) for _, r in rings])
    real = (p != q).any(1)
    p, q, shape = p[real], q[real], shape[real]
    if not len(p):
        return
    a, b = meeting(p, q)
    middle, way = (a + b) / 2, b - a
    normal = np.stack([-way[:, 1], way[:, 0]], 1) / np.hypot(way[:, 0], way[:, 1])[:, None]
    left, right = (insides(middle + side * BESIDE * normal, p, q, shape, n_shapes) for side in (1, -1))
    yield a, b, left, right


def _oriented(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boundary pieces with the inside on the left."""
    edge = left != right
    a, b, left = a[edge], b[edge], left[edge]
    return np.where(left[:, None], a, b), np.where(left[:, None], b, a)


def _area(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a):
        return 0.0
    o = a[0]
    return float(((a[:, 0] - o[0]) * (b[:, 1] - o[1]) - (a[:, 1] - o[1]) * (b[:, 0] - o[0])).sum() / 2)


def _cell(rows: pd.DataFrame) -> tuple[list[str], np.ndarray, list[tuple[int, np.ndarray]]]:
    """Shapes, their sides, and rings by number of shape. What a shape's name and side are doesn't depend on the order of rows."""
    names = sorted(set(zip(rows["shape"], rows["side"])))
    number = {n: k for k, n in enumerate(names)}
    rings = [(number[s, side], np.stack([np.asarray(x, float), np.asarray(y, float)], 1)) for s, side, x, y in zip(rows["shape"], rows["side"], rows["xs"], rows["ys"], strict=True)]
    return [n for n, _ in names], np.array([side for _, side in names]), rings


def _box(cx: int, cy: int, cell: float) -> Box:
    return tuple(round(ORIGIN[k % 2] + (c + k // 2) * cell, DIGITS) for k, c in enumerate((cx, cy, cx, cy)))


def areas(pieces: DataFrame, cell: float, most: int = MOST) -> DataFrame:
    """key, shape, area, beyond: for each shape of side 0 its area, and the area of it that no shape of side 1 covers, in square units; and with shape null the union of side 0, and what side 1 leaves of it."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names, side, rings = _cell(rows)
        first = np.flatnonzero(side == 0)
        own, beyond = np.zeros(len(first) + 1), np.zeros(len(first) + 1)
        for a, b, left, right in solve_cell(rings, len(names), _box(int(key[1]), int(key[2]), cell), most):
            covered = [s[:, side == 1].any(1) for s in (left, right)]
            for k in range(len(first) + 1):
                here = [s[:, first[k]] if k < len(first) else s[:, first].any(1) for s in (left, right)]
                own[k] += _area(*_oriented(a, b, *here))
                beyond[k] += _area(*_oriented(a, b, *[h & ~c for h, c in zip(here, covered, strict=True)]))
        return pd.DataFrame({"key": key[0], "shape": [*[names[k] for k in first], None], "area": own, "beyond": beyond})

    parts = pieces.groupBy("key", "cx", "cy").applyInPandas(work, "key string, shape string, area double, beyond double")
    return parts.groupBy("key", "shape").agg(F.sum("area").alias("area"), F.sum("beyond").alias("beyond"))


def boundary(pieces: DataFrame, cell: float, most: int = MOST) -> DataFrame:
    """key, x0, y0, x1, y1: boundary of the union of side 0 without side 1, the inside on the left, in pieces that end at the grid at the latest."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names, side, rings = _cell(rows)
        out = []
        box = _box(int(key[1]), int(key[2]), cell)
        for a, b, left, right in solve_cell(rings, len(names), box, most):
            inside = [s[:, side == 0].any(1) & ~s[:, side == 1].any(1) for s in (left, right)]
            out.append(np.concatenate(_oriented(a, b, *inside), 1))
        seg = np.concatenate(out) if out else np.zeros((0, 4))
        # what runs along the border of the cell, or of a quarter of it, comes twice in opposite directions or borders on nothing here
        for c, low, high in ((0, box[0], box[2]), (1, box[1], box[3])):
            along = (seg[:, c] == seg[:, c + 2]) & ((seg[:, c] == low) | (seg[:, c] == high))
            seg = seg[~along]
        back = {tuple(s) for s in seg[:, [2, 3, 0, 1]]}
        seg = np.array([s for s in seg if tuple(s) not in back]).reshape(-1, 4)
        return pd.DataFrame({"key": key[0], **{n: seg[:, k] for k, n in enumerate(("x0", "y0", "x1", "y1"))}})

    return pieces.groupBy("key", "cx", "cy").applyInPandas(work, "key string, x0 double, y0 double, x1 double, y1 double")


def rings_of(segments: DataFrame) -> DataFrame:
    """key, ring (array of (x, y) arrays, without the first point again), from boundary pieces: the outside counter-clockwise, holes clockwise. Straight points go."""
    spot = lambda x, y: F.xxhash64("key", x, y)
    s = cut(segments.withColumn("a", spot("x0", "y0")).withColumn("b", spot("x1", "y1")))
    part = component_labels(s.select(F.col("a").alias("node")).distinct(), s.select("a", "b"))

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # the pieces of one connected boundary: one polygon's outline, as large as the value that it becomes
        out_of: dict[tuple, list[tuple]] = {}
        for x0, y0, x1, y1 in sorted(zip(rows["x0"], rows["y0"], rows["x1"], rows["y1"], strict=True)):
            out_of.setdefault((x0, y0), []).append((x1, y1))
        found = []
        while out_of:
            start = min(out_of)
            ring, at, came = [], start, None
            while True:
                ways = out_of[at]
                if len(ways) > 1 and came is not None:  # the way most to the right, so that rings that touch stay apart
                    back = np.arctan2(came[1] - at[1], came[0] - at[0])
                    ways.sort(key=lambda w: (np.arctan2(w[1] - at[1], w[0] - at[0]) - back) % (2 * np.pi))
                to = ways.pop()
                if not ways:
                    del out_of[at]
                ring.append(at)
                came, at = at, to
                if at == start or at not in out_of:
                    break
            pts = np.array(ring)
            ahead, behind = np.roll(pts, -1, 0) - pts, pts - np.roll(pts, 1, 0)
            bend = np.abs(ahead[:, 0] * behind[:, 1] - ahead[:, 1] * behind[:, 0]) > 1e-9 * np.hypot(*ahead.T) * np.hypot(*behind.T)
            found.append(pts[bend].tolist())
        return pd.DataFrame({"key": rows["key"].iloc[0], "ring": [r for r in found if len(r) >= 3]})

    on = s.join(part, s["a"] == part["node"]).select("key", "label", "x0", "y0", "x1", "y1")
    return on.groupBy("key", "label").applyInPandas(join, "key string, ring array<array<double>>")


def buffered(rings: DataFrame, by: float, sides: int = 16) -> DataFrame:
    """rings and, as shapes of their own, each of their edges widened by a distance with round ends: their union is the shapes with a margin."""
    p = F.filter("ring", lambda x: x.isNotNull())
    edges = rings.select("key", "side", F.posexplode(F.arrays_zip(p.alias("a"), F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1)).alias("b"))).alias("k", "e"), F.col("shape"))
    x0, y0, x1, y1 = F.col("e.a")[0], F.col("e.a")[1], F.col("e.b")[0], F.col("e.b")[1]
    turn = F.atan2(y1 - y0, x1 - x0)
    steps = [F.lit(np.pi * k / (sides // 2)) for k in range(sides // 2 + 1)]
    around = lambda x, y, start: [F.array(x + by * F.cos(turn + start + s), y + by * F.sin(turn + start + s)) for s in steps]
    capsule = F.array(*around(x1, y1, -np.pi / 2), *around(x0, y0, np.pi / 2))
    wide = edges.select("key", F.concat_ws("/", "shape", F.xxhash64(F.to_json("e")).cast("string")).alias("shape"), "side", capsule.alias("ring"))
    return rings.select("key", "shape", "side", "ring").unionByName(wide)


def simplified(ring: list, tolerance: float) -> list:
    """The points of a ring that a line within the tolerance needs: the farthest one between two kept points stays while it is farther off."""
    pts = np.asarray(ring, float)
    far = int(np.hypot(*(pts - pts[0]).T).argmax())
    pts = np.concatenate([pts, pts[:1]])
    keep = np.zeros(len(pts), bool)
    keep[[0, far, len(pts) - 1]] = True
    todo = [(0, far), (far, len(pts) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d, v = pts[j] - pts[i], pts[i + 1 : j] - pts[i]
        length = float(d @ d)
        t = np.clip((v @ d) / length, 0, 1) if length else np.zeros(len(v))
        off = np.hypot(*(v - t[:, None] * d).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return pts[:-1][keep[:-1]].tolist()


def km2(area, lat):
    """Square kilometres of an area in square degrees near a latitude."""
    return area * DEGREE_KM**2 * F.cos(F.radians(lat))
