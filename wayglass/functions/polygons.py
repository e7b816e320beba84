"""Polygons of regions and boundaries in numpy: areas, clipping to a box, outlines. For some hundred regions, so a pandas function does."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed value: kilometres to a degree.
DEGREE_KM = 111.32


def area_km2(ring: list) -> float:
    """Area of a ring of (lon, lat), on a plane scaled at its mean latitude."""
    if len(ring) < 3:
        return 0.0
    p = np.asarray(ring, float)
    x, y = p[:, 0] * np.cos(np.radians(p[:, 1].mean())) * DEGREE_KM, p[:, 1] * DEGREE_KM
    x, y = x - x[0], y - y[0]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def clipped(ring: list, box: tuple[float, float, float, float]) -> list:
    """The part of a ring inside a box: cut off by each of its four sides in turn."""
    west, south, east, north = box
    for axis, limit, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        kept = []
        for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True):
            ina, inb = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            if ina:
                kept.append(a)
            if ina != inb:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                kept.append([a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])])
        ring = kept
        if not ring:
            break
    return ring


@F.pandas_udf(DoubleType())
def covered_km2(points: pd.Series, west: pd.Series, south: pd.Series, east: pd.Series, north: pd.Series) -> pd.Series:
    """Area of the part of a polygon that lies in a box."""
    return pd.Series([area_km2(clipped([list(p) for p in ring], box)) for ring, *box in zip(points, west, south, east, north, strict=True)])


def outline(rings: list[list]) -> str:
    """A GeoJSON feature of rings."""
    return json.dumps({"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[*r, r[0]] for r in rings]}}, separators=(",", ":"))
