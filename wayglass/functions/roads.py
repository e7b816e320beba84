"""Road tags to columns. tags: a map column; empty strings count as missing where the rules say so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: km/h without a usable maxspeed, by highway class.
DEFAULT_KMH = {
    "motorway": 105, "motorway_link": 60, "trunk": 90, "trunk_link": 50, "primary": 65, "primary_link": 45, "secondary": 55, "secondary_link": 40,
    "tertiary": 45, "tertiary_link": 35, "unclassified": 40, "residential": 30, "living_street": 15, "service": 20,
}
#: Kinds of service road, and values of access, that cars don't use.
SKIPPED_SERVICE = ("parking_aisle", "driveway", "drive-through", "emergency_access")
NO_ACCESS = ("no", "private", "agricultural", "forestry")
SIGNAL_DELAY_S = 8.0
LABEL_SEPARATOR = "\x1f"


def tag(tags: str, key: str) -> Column:
    return F.element_at(tags, key)


def drivable(tags: str = "tags") -> Column:
    """The highway class if cars may use the way, else null. The most specific access tag decides."""
    hw = tag(tags, "highway")
    access = F.coalesce(*[tag(tags, k) for k in ("motorcar", "motor_vehicle", "vehicle", "access")])
    usable = hw.isin(*DEFAULT_KMH) & ~tag(tags, "area").eqNullSafe("yes") & ~((hw == "service") & F.coalesce(tag(tags, "service").isin(*SKIPPED_SERVICE), F.lit(False)))
    return F.when(usable & ~F.coalesce(access.isin(*NO_ACCESS), F.lit(False)), hw)


def named_service(tags: str = "tags") -> Column:
    return tag(tags, "name").isNotNull() & ~tag(tags, "service").eqNullSafe("alley")


def directions(tags: str = "tags") -> Column:
    """struct(fwd, rev): the directions in which a way may be driven."""
    way = F.coalesce(tag(tags, "oneway"), F.lit(""))
    pair = lambda f, r: F.struct(F.lit(f).alias("fwd"), F.lit(r).alias("rev"))
    return (
        F.when(way.isin("-1", "reverse"), pair(False, True))
        .when(way.isin("yes", "true", "1") | F.coalesce(tag(tags, "junction").isin("roundabout", "circular"), F.lit(False)), pair(True, False))
        .when(F.coalesce(tag(tags, "highway").isin("motorway", "motorway_link"), F.lit(False)) & (way != "no"), pair(True, False))
        .otherwise(pair(True, True))
    )


def parse_maxspeed(value: Column) -> Column:
    """km/h, or null where it isn't a plain number (mph allowed) of 5 to 140 km/h."""
    pattern = r"^\s*([0-9]+(?:[.][0-9]+)?)\s*(mph)?\s*$"
    kmh = F.nullif(F.regexp_extract(value, pattern, 1), F.lit("")).try_cast("double") * F.when(F.regexp_extract(value, pattern, 2) == "mph", 1.609344).otherwise(1.0)
    return F.when(kmh.between(5, 140), kmh)


def speed(tags: str = "tags") -> Column:
    defaults = F.create_map(*[F.lit(x) for k, v in DEFAULT_KMH.items() for x in (k, float(v))])
    return F.coalesce(parse_maxspeed(tag(tags, "maxspeed")), F.element_at(defaults, tag(tags, "highway")))


def listed(value: Column) -> Column:
    """A value of several parts, as a list to read."""
    return F.coalesce(F.array_join(F.filter(F.transform(F.split(value, ";"), lambda p: F.trim(p)), lambda p: p != ""), "; "), F.lit(""))


def label(tags: str = "tags") -> Column:
    """Name, number and destination of a road, parted by U+001F; empty without any."""
    some = lambda k: F.nullif(tag(tags, k), F.lit(""))
    name, ref = listed(tag(tags, "name")), listed(tag(tags, "ref"))
    to = listed(F.coalesce(some("destination"), some("destination:ref"), some("destination:street")))
    return F.when((name != "") | (ref != "") | (to != ""), F.concat_ws(LABEL_SEPARATOR, name, ref, to)).otherwise("")


def format_ref(ref: Column) -> Column:
    """Route numbers as signs write them."""
    return F.array_join(F.transform(F.filter(F.split(ref, r"\s*;\s*"), lambda r: r != ""), lambda r: F.regexp_replace(r, r"^(I|US)\s+(?=[0-9])", "$1-")), "/")
