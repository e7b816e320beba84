"""Queries over the map source: the tables are written as map objects in XML, read back through the source, and compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayglass.sources import adapters as src
from wayglass.sources import osm_source as osm

from . import graph_queries as gq
from .iterate import written_lines


def _nodes(spark, d) -> str:
    n = src.road_nodes(spark, d).select(F.col("node_id").alias("id"), (F.col("y") / 1000).alias("lat"), (F.col("x") / 1000).alias("lon"), F.when(F.col("has_signal"), F.create_map(F.lit("highway"), F.lit("traffic_signals"))).otherwise(F.create_map(F.lit("name"), F.col("name"))).alias("tags"))
    return written_lines(n.select(osm.element("node", "id lat lon")), "nodes")


def _ways(spark, d) -> str:
    w = gq.tagged(spark, d).withColumn("refs", F.sequence(F.col("id"), F.col("id") + F.col("id") % 4))
    return written_lines(w.select(osm.element("way", "id")), "ways")


def _relations(spark, d) -> str:
    r = gq.restrictions(spark, d)
    k = F.col("rid")
    tags = F.map_filter(
        F.create_map(F.lit("type"), F.when(k % 17 == 4, "route").otherwise("restriction"), F.lit("restriction"), F.col("kind"), F.lit("restriction:motorcar"), F.when(k % 11 == 0, "no_u_turn"), F.lit("except"), F.when(k % 7 == 0, "bicycle;motorcar")),
        lambda _, v: v.isNotNull(),
    )
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), ref.cast("long").alias("ref"), F.lit(role).alias("role"))
    ways = [member("way", F.col("from_way"), "from"), member("node", F.col("via"), "via"), member("way", F.col("to_way"), "to")]
    members = F.when(k % 13 == 0, F.array(*ways, member("way", F.col("to_way"), "from"))).otherwise(F.array(*ways))
    return written_lines(r.select(k.alias("id"), tags.alias("tags"), members.alias("members")).select(osm.element("relation", "id")), "relations")


def osm_scan_roads(spark, d):
    return osm.drivable_ways(spark, _ways(spark, d)).select("id", "class", F.round("kmh", 6).alias("kmh"), "fwd", "rev", F.size("refs").cast("long").alias("n_refs"))


def osm_scan_signals(spark, d):
    return osm.signals(spark, _nodes(spark, d))


def osm_scan_restrictions(spark, d):
    return osm.turn_restrictions(spark, _relations(spark, d)).filter("supported").drop("supported")


QUERIES = {f.__name__: f for f in (osm_scan_roads, osm_scan_signals, osm_scan_restrictions)}

ORACLES = {
    "osm_scan_roads": f"""WITH {gq.TAGS}, k AS (SELECT id, highway AS class, CAST((map {{'50': 50.0, '30 mph': 48.28032, ' 60 ': 60.0}})[maxspeed] AS DOUBLE) AS tagged, oneway, junction, id % 4 + 1 AS n_refs FROM t
            WHERE highway <> 'footway' AND area IS NULL AND NOT (highway = 'service' AND coalesce(service, '') = 'driveway') AND coalesce(motorcar, motor_vehicle, access, 'yes') NOT IN ('no', 'private')
            AND NOT (highway = 'service' AND (name IS NULL OR coalesce(service, '') = 'alley')) AND id % 4 > 0)
        SELECT id, class, coalesce(tagged, (map {{'motorway': 105.0, 'primary': 65.0, 'residential': 30.0, 'service': 20.0, 'motorway_link': 60.0}})[class]) AS kmh, NOT coalesce(oneway IN ('-1', 'reverse'), false) AS fwd,
            CASE WHEN oneway IN ('-1', 'reverse') THEN true WHEN oneway IN ('yes', '1') OR junction IS NOT NULL THEN false WHEN class IN ('motorway', 'motorway_link') AND coalesce(oneway, '') <> 'no' THEN false ELSE true END AS rev, n_refs FROM k""",
    "osm_scan_signals": f"WITH {gq.WAYS} SELECT n AS id, y / 1000 AS lat, x / 1000 AS lon FROM rn WHERE sig",
    "osm_scan_restrictions": f"""WITH {gq.WAYS} SELECT n AS rid, CASE WHEN n % 11 = 0 THEN 'no_u_turn' ELSE (['no_right_turn', 'no_left_turn', 'only_straight_on', 'only_right_turn', 'no_entry'])[n % 5 + 1] END AS kind, n // 20 AS from_way, n AS via,
            CASE WHEN n % 5 = 2 THEN n // 20 ELSE 100000 + n % 20 END AS to_way FROM rn WHERE (n % 20) % 3 = 0 AND n % 4 = 0 AND n % 17 <> 4 AND n % 7 <> 0 AND n % 13 <> 0""",
}
