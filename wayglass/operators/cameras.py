"""Cameras: zones, capture sites, and which stretches of road each site covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayglass.functions import geo
from wayglass.operators.proximity import proximity_join
from wayglass.plans.iterate import component_labels

STEP_M = 5.0


def camera_zones(cameras: DataFrame, params: tuple[float, float, float, float] = geo.PROFILES["default"], both_ways: bool = False, omni: bool = False) -> DataFrame:
    """cameras with mode, sectors, range_m, eps_m, tol, ref_m."""
    range_m, half, eps, tol = params
    parsed = geo.parse_direction("direction")
    sectors = F.when(parsed.isNull(), F.array(F.struct(F.lit(0.0).alias("bearing"), F.lit(180.0).alias("half_angle")))).otherwise(
        F.transform(parsed, lambda s: F.struct(s["bearing"].alias("bearing"), F.least(F.lit(180.0), s["extra"] + half).alias("half_angle")))
    )
    brand = F.coalesce(F.nullif(F.col("brand"), F.lit("")), F.lit(""))
    mode = F.when(parsed.isNull() | F.lit(omni), "any").when(brand.startswith("Flock") & ~F.lit(both_ways), "rear").otherwise("axis")
    out = cameras.withColumns({"mode": mode, "sectors": sectors, "range_m": F.lit(range_m), "eps_m": F.lit(eps), "tol": F.lit(tol)})
    return out.withColumn("ref_m", geo.reference_length(F.get("sectors", F.lit(0))["half_angle"], "range_m", "eps_m"))


def site_pairs(cameras: DataFrame, radius: float = geo.SITE_RADIUS_M) -> DataFrame:
    """a < b: cameras within the radius of each other."""
    left = cameras.select(F.col("id").alias("a"), "x", "y")
    right = cameras.select(F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return proximity_join(left, right.hint("merge"), radius).filter("a < b").select("a", "b")  # as many as cameras: never broadcast


def capture_sites(cameras: DataFrame, radius: float = geo.SITE_RADIUS_M) -> DataFrame:
    """id, site: sites are named by their smallest camera."""
    labels = component_labels(cameras.select(F.col("id").alias("node")), site_pairs(cameras, radius))
    return labels.select(F.col("node").alias("id"), F.col("label").alias("site"))


def samples(segments: DataFrame, step: float = STEP_M) -> DataFrame:
    """Points every `step` metres along segments (geom_id, k, ax, ay, bx, by, s0, is_last): j, x, y, along, weight, heading.

    The last segment of a geometry also has its end, with weight 0.
    """
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    own = segments.withColumn("len", length).filter("len > 0.01")
    own = own.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("len") / step)).cast("int"))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(F.col("is_last"), F.col("n")).otherwise(F.col("n") - 1))))
    t = F.col("j") / F.col("n")
    return own.select(
        "geom_id", "k", "j", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"),
        (F.col("s0") + t * F.col("len")).alias("along"), F.when(F.col("j") < F.col("n"), F.col("len") / F.col("n")).otherwise(0.0).alias("weight"), geo.bearing(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("heading"),
    )


def exposure(segments: DataFrame, edges: DataFrame, zones: DataFrame, sites: DataFrame) -> DataFrame:
    """edge_id, site, entry_m, exit_m, units, at_end. edges: edge_id, geom_id, rev, len.

    Samples meet cameras by grid cell, then by a circle, then by the exact predicate for each direction of travel that
    has an edge; a sample counts once for a site, however many of its cameras see it.
    """
    reach = zones.agg(F.max(F.col("range_m") + F.col("eps_m"))).first()[0] or 1.0
    cams = zones.join(sites, "id").select("site", F.col("x").alias("x2"), F.col("y").alias("y2"), "mode", "sectors", "range_m", "eps_m", "tol")
    near = proximity_join(samples(segments), cams, reach).join(edges.select("edge_id", "geom_id", "rev", F.col("len").alias("edge_m")), "geom_id")
    heading = geo.mod360(F.col("heading") + F.when(F.col("rev"), 180.0).otherwise(0.0))
    seen = near.filter(geo.captures(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"), heading, "mode", F.col("sectors"), "range_m", "eps_m", "tol"))
    once = seen.dropDuplicates(["site", "edge_id", "k", "j"])
    along = F.when(F.col("rev"), F.col("edge_m") - F.col("along")).otherwise(F.col("along"))
    ref = zones.join(sites, "id").groupBy("site").agg(F.max("ref_m").alias("ref_m"))
    out = once.groupBy("edge_id", "site").agg(F.min(along).alias("entry_m"), F.max(along).alias("exit_m"), F.sum("weight").alias("metres"), F.first("edge_m").alias("edge_m"))
    return out.join(ref, "site").select("edge_id", "site", "entry_m", "exit_m", F.least(F.lit(1.0), F.col("metres") / F.col("ref_m")).alias("units"), (F.col("exit_m") >= F.col("edge_m") - 0.05).alias("at_end"))


def watches(mode: Column, sectors: Column) -> Column:
    """What a camera watches, in words."""
    ways = lambda shift: F.transform(sectors, lambda s: geo.compass8(geo.mod360(s["bearing"] + shift)))
    both = F.zip_with(ways(0.0), ways(180.0), lambda a, b: F.concat(a, F.lit("–"), b))
    return F.when(mode == "any", "direction unknown").when(mode == "rear", F.concat(F.lit("reads plates heading "), F.array_join(ways(0.0), " & "))).otherwise(F.concat(F.lit("reads plates along "), F.array_join(both, " & ")))


def site_cards(zones: DataFrame, sites: DataFrame) -> DataFrame:
    """site, n, title (brands, each once, in the order of their cameras; how many cameras), watches (of the first camera). zones: id, brand, mode, sectors; sites: id, site."""
    brand = F.coalesce(F.nullif("brand", F.lit("")), F.lit("Unknown brand"))
    rows = zones.join(sites, "id").groupBy("site").agg(F.array_sort(F.collect_list(F.struct("id", brand.alias("brand")))).alias("cams"), F.min_by(watches(F.col("mode"), F.col("sectors")), "id").alias("watches"))  # cameras of one site
    n = F.size("cams")
    title = F.concat(F.array_join(F.array_distinct(F.transform("cams", lambda c: c["brand"])), ", "), F.when(n > 1, F.concat(F.lit(" · "), n.cast("string"), F.lit(" cameras"))).otherwise(""))
    return rows.select("site", n.alias("n"), title.alias("title"), "watches")


def with_rings(zones: DataFrame, rings: DataFrame, weight: float = geo.RING_WEIGHT) -> DataFrame:
    """Exposure of zones and rings in one table: the ring is a site of its own, weights add up to 1."""
    a = zones.withColumns({"layer": F.lit("zone"), "weight": F.lit(1 - weight)})
    return a.unionByName(rings.withColumns({"layer": F.lit("ring"), "weight": F.lit(weight)}))


def camera_score(n_zones: Column, n_rings: Column) -> Column:
    return n_zones + geo.RING_WEIGHT * n_rings
