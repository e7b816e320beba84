"""Plane geometry of roads and cameras as Column expressions: all of it stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres to a degree for routing, and for place search.
ROUTE_DEGREE_M = 111194.92664455873
PLACE_DEGREE_M = 111320.0

#: The sixteen compass points in degrees.
COMPASS = {
    "N": 0.0, "NNE": 22.5, "NE": 45.0, "ENE": 67.5, "E": 90.0, "ESE": 112.5, "SE": 135.0, "SSE": 157.5,
    "S": 180.0, "SSW": 202.5, "SW": 225.0, "WSW": 247.5, "W": 270.0, "WNW": 292.5, "NW": 315.0, "NNW": 337.5,
}

#: Zone parameters of each profile (range m, half angle, slack m, heading tolerance), and the ring around each.
PROFILES = {"strict": (25.0, 15.0, 8.0, 30.0), "default": (50.0, 30.0, 12.0, 45.0), "loose": (100.0, 45.0, 20.0, 60.0)}
RINGS = {"strict": PROFILES["default"], "default": PROFILES["loose"], "loose": (150.0, 60.0, 25.0, 75.0)}
RING_WEIGHT = 0.25
SITE_RADIUS_M = 25.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def wrap180(d) -> Column:
    return F.pmod(col(d) + 180.0, F.lit(360.0)) - 180.0


def mod360(d) -> Column:
    return F.pmod(col(d), F.lit(360.0)) + 0.0


def bearing(dx, dy) -> Column:
    """Compass bearing of (east, north)."""
    return mod360(F.degrees(F.atan2(col(dx), col(dy))))


def project(lon, lat, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Equirectangular metres about an origin."""
    return (col(lon) - lon0) * ROUTE_DEGREE_M * F.cos(F.radians(F.lit(lat0))), (col(lat) - lat0) * ROUTE_DEGREE_M


def unproject(x, y, lon0: float, lat0: float) -> tuple[Column, Column]:
    return col(x) / (ROUTE_DEGREE_M * F.cos(F.radians(F.lit(lat0)))) + lon0, col(y) / ROUTE_DEGREE_M + lat0


def metres_between(lon1, lat1, lon2, lat2) -> Column:
    """Place search's distance: cosine of the mid latitude."""
    mid = F.radians((col(lat1) + col(lat2)) / 2)
    return F.hypot((col(lon2) - col(lon1)) * F.cos(mid), col(lat2) - col(lat1)) * PLACE_DEGREE_M


def sector_distance(px, py, bearing_, half_angle, range_m) -> Column:
    """Distance from a point, relative to the apex, to the sector; 0 inside."""
    px, py, r = col(px), col(py), col(range_m)
    d = F.hypot(px, py)
    off = F.abs(wrap180(bearing(px, py) - col(bearing_)))
    phi = F.radians(F.least(off - col(half_angle), F.lit(180.0)))
    along = d * F.cos(phi)
    return (
        F.when(off <= col(half_angle), F.greatest(d - r, F.lit(0.0)))
        .when(along <= 0, d)
        .when(along >= r, F.sqrt(F.greatest(d * d + r * r - 2 * d * r * F.cos(phi), F.lit(0.0))))
        .otherwise(d * F.sin(phi))
    )


def heading_matches(heading, bearing_, mode, tolerance) -> Column:
    off = F.abs(wrap180(col(heading) - col(bearing_)))
    return F.when(col(mode) == "any", True).when(col(mode) == "rear", off <= col(tolerance)).otherwise(F.least(off, 180.0 - off) <= col(tolerance))


def captures(dx, dy, heading, mode, sectors, range_m, eps_m, tolerance) -> Column:
    """Does a vehicle at (dx, dy) from a camera, on a heading, pass one of the camera's sectors?"""
    return F.exists(sectors, lambda s: (sector_distance(dx, dy, s["bearing"], s["half_angle"], range_m) <= col(eps_m)) & heading_matches(heading, s["bearing"], mode, tolerance))


def parse_direction(text) -> Column:
    """Sectors (bearing, extra half width) of a direction tag; null if any part of it is unusable, or all are empty."""
    number, span = r"^-?[0-9]+([.][0-9]+)?$", r"^([0-9]+(?:[.][0-9]+)?)\s*-\s*([0-9]+(?:[.][0-9]+)?)$"
    points = F.create_map(*[F.lit(x) for pair in COMPASS.items() for x in pair])

    def sector(p: Column) -> Column:
        value = p.try_cast("double")
        a, b = (F.nullif(F.regexp_extract(p, span, k), F.lit("")).try_cast("double") for k in (1, 2))
        width = mod360(b - a)
        made = lambda x, y: F.struct(x.alias("bearing"), y.alias("extra"))
        return (
            F.when(p.rlike(number), F.when(F.abs(value) <= 360, made(mod360(value), F.lit(0.0))))
            .when(p.rlike(span), F.when((a <= 360) & (b <= 360), made(mod360(a + width / 2), width / 2)))
            .when(F.element_at(points, p).isNotNull(), made(F.element_at(points, p), F.lit(0.0)))
        )

    parts = F.filter(F.transform(F.split(F.upper(col(text)), ";"), lambda p: F.trim(p)), lambda p: p != "")
    sectors = F.transform(parts, sector)
    return F.when((F.size(parts) > 0) & ~F.exists(sectors, lambda s: s.isNull()), sectors)


def direction_quality(text) -> Column:
    """The survey's own classes of a direction tag, by other rules than parse_direction."""
    t = F.trim(col(text))
    one = F.upper(t)
    value = t.try_cast("double")
    return (
        F.when(t.isNull() | (t == ""), "missing")
        .when(F.lower(t).isin("forward", "backward", "both"), "non-bearing")
        .when(t.contains(";") | t.rlike(r"^[0-9.]+\s*-\s*[0-9.]+$"), "multi")
        .when(t.rlike(r"^-?[0-9]+([.][0-9]+)?$"), F.when((value >= 0) & (value <= 360), "ok").otherwise("out-of-range"))
        .when(one.isin(*COMPASS), "ok")
        .otherwise("unparseable")
    )


def reference_length(half_angle, range_m, eps_m) -> Column:
    """Length of a straight pass through the middle of a zone."""
    return F.when(col(half_angle) >= 180, 2 * (col(range_m) + col(eps_m))).otherwise(col(range_m) + 2 * col(eps_m))


def turn_cost(turn) -> Column:
    """Seconds for a change of heading, right-hand positive."""
    t = col(turn)
    size = F.abs(t)
    return F.when(size <= 30, 0.0).when(size <= 60, 2.0).when(size > 150, 15.0).when(t > 0, 4.0).otherwise(9.0)


def turn_class(turn) -> Column:
    t = col(turn)
    return F.when(F.abs(t) < 40, "straight").when(F.abs(t) > 160, "u").when(t > 0, "right").otherwise("left")


def direction_word(turn) -> Column:
    """The word that directions use for a turn."""
    t = col(turn)
    size, side = F.abs(t), F.when(t >= 0, "right").otherwise("left")
    return F.when(size < 20, "straight").when(size < 60, F.concat(F.lit("slight "), side)).when(size < 140, side).when(size < 170, F.concat(F.lit("sharp "), side)).otherwise("uturn")


def compass8(heading) -> Column:
    names = F.array(*[F.lit(x) for x in ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")])
    return F.get(names, F.pmod(F.floor(col(heading) / 45 + 0.5).cast("int"), F.lit(8)))


def sector_points(x, y, bearing_, half_angle, range_m, steps: int = 8) -> Column:
    """Outline of a sector for display: the apex, then the arc."""
    arc = F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda k: F.struct(
            (col(x) + col(range_m) * F.sin(F.radians(col(bearing_) - col(half_angle) + 2 * col(half_angle) * k / steps))).alias("x"),
            (col(y) + col(range_m) * F.cos(F.radians(col(bearing_) - col(half_angle) + 2 * col(half_angle) * k / steps))).alias("y"),
        ),
    )
    return F.concat(F.array(F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))), arc)
