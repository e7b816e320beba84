"""Queries over release jobs, evaluations and positions on polylines, and their SQL, which is written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.functions import text
from wayglass.operators import evaluate as ev
from wayglass.operators import jobs, lines
from wayglass.operators.release import newest
from wayglass.sources import adapters as src
from wayglass.sources import feeds

# ------------------------------------------------------------------------------------------ adapters

NOW = "2026-03-01T12:00:00Z"


def _orders(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return src.table(spark, d, "orders").selectExpr(*columns)


def configured_regions(spark: SparkSession, d: str) -> DataFrame:
    """place, id, batch, west, south, east, north, sources: nations, those of one continent listed twice, some of them wrong."""
    n = src.table(spark, d, "nation")
    again = n.filter("n_regionkey = 1").withColumn("again", F.lit(100))
    k = F.col("n_nationkey")
    own = jobs.slug(F.col("n_name"))
    return n.withColumn("again", F.lit(0)).unionByName(again).select(
        (k + F.col("again")).alias("place"), F.when(k % 8 == 3, F.col("n_name")).otherwise(own).alias("id"), F.col("n_regionkey").alias("batch"),
        (k * 7 - 100).alias("west"), (k - 20).alias("south"), (k * 7 - 100 + k % 5 * 2).alias("east"), (k - 20 + k % 6).alias("north"),
        F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.concat(F.lit("us/state-"), ((k + i * (k % 2)) % 4).cast("string"))).alias("sources"),
    )


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """id, run, pair, lam, t, d, l, with t0 and d0: rows of trips at several prices; some trips have no row without a price."""
    rows = _orders(spark, d, "o_orderkey as id", "o_orderkey % 2 as run", "o_custkey as pair", "o_orderkey div 2 % 6 * 30 as lam", "cast(600 + o_orderkey % 97 as double) as t", "o_orderkey * 7 % 11 as d", "3000 + o_orderkey % 1000 as l")
    return ev.with_baseline(rows, ["run", "pair"], ["t", "d"])


def polylines(spark: SparkSession, d: str) -> DataFrame:
    n = src.table(spark, d, "nation").select(F.col("n_nationkey").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    return n.select("line", "k", (F.col("k") * 500 + F.col("line") * 13 % 7 * 10).cast("double").alias("x"), ((F.col("line") * 7 + F.col("k") * 3) % 5 * 60 + F.col("line")).cast("double").alias("y"))


def maneuvers(spark: SparkSession, d: str) -> DataFrame:
    n = src.table(spark, d, "nation").select(F.col("n_nationkey").alias("route_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("step"))
    kind = F.when(F.col("step") == 0, "depart").when(F.col("step") == 6, "arrive").otherwise("turn")
    return n.select("route_id", "step", kind.alias("kind"), (F.col("step") * 600 - F.when(F.col("step") % 2 == 0, F.col("route_id") * 25).otherwise(0)).cast("double").alias("at_m"))


def driven(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "events").selectExpr("user_id % 25 as route_id", "event_id as fix", "cast(event_id * 53 % 4000 as double) as along_m", "cast(event_id % 35 as double) as speed")


# ------------------------------------------------------------------------------------------- queries


def tile_dedupe(spark, d):
    return newest(_orders(spark, d, "o_custkey as id", "o_orderkey % 18 as tile", "o_orderkey as record"), ["id"], [F.col("tile"), F.col("record")]).select("id", "tile")


def feed_gate(spark, d):
    c = src.table(spark, d, "customer").select(F.col("c_nationkey").alias("region"), "c_custkey")
    fresh = c.filter(F.when(F.col("region") % 9 == 4, F.lit(False)).otherwise(F.col("c_custkey") % (F.col("region") % 4 + 1) == 0))
    return jobs.feed_gates(fresh, c.filter("region % 7 <> 6"), "region")


def region_validate(spark, d):
    out = jobs.region_problems(configured_regions(spark, d))
    return out.select("place", "id", F.array_join("problems", ", ").alias("problems"))


def listing_parse(spark, d):
    time = F.when(F.col("id") % 5 == 0, " bad").when(F.col("id") % 7 == 0, "").otherwise("\t1998-01-02T03:04:05Z")
    key = F.when(F.col("id") % 17 == 0, "None").otherwise(F.concat(F.lit("packs/"), F.col("c").cast("string"), F.lit(".fwr")))
    at = feeds.listed(_orders(spark, d, "o_orderkey as id", "o_custkey as c").withColumn("value", F.concat(F.lit("  "), key, time)))
    return at.select("id", "key", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"))


def release_paths(spark, d):
    n = src.table(spark, d, "nation")
    return n.select(jobs.slug(F.col("n_name")).alias("region"), jobs.hashed_path("packs", jobs.slug(F.col("n_name")), F.col("n_name"), ".fwr").alias("path"))


def manifest_merge(spark, d):
    c = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("version"), F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit("b"), F.col("c_custkey").cast("string"))).alias("basemap"))
    config = c.filter("id % 7 <> 0").select("id", F.col("id").alias("place"))
    live = c.filter("id % 4 <> 0").select("id", (F.col("version") + 100).alias("version"), F.coalesce("basemap", F.when(F.col("id") % 2 == 1, "old")).alias("basemap"))
    return jobs.assembled(config, c.filter("id % 3 <> 0"), live, c.filter("id % 5 <> 0").select("id"))


def manifest_reuse(spark, d):
    """Parts of a build against the live ones: an equal fingerprint keeps the live file."""
    c = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "pack").otherwise("places").alias("kind"), (F.col("c_nationkey") % 6).alias("fingerprint"), F.concat(F.lit("new/"), F.col("c_custkey").cast("string")).alias("path"))
    live = c.filter("id % 5 <> 0").select("id", "kind", (F.col("id") % 6).alias("fingerprint"), F.concat(F.lit("live/"), F.col("id").cast("string")).alias("path"))
    return jobs.reused(c, live)


def prune_keys(spark, d):
    folders = F.array(*[F.lit(x) for x in ("packs/", "basemap/", "places/", "basemap/assets/", "cameras/", "packs/")])
    o = _orders(spark, d, "o_orderkey as k", "o_custkey as c")
    listing = o.select(F.concat(F.get(folders, (F.col("k") % 6).cast("int")), F.col("k").cast("string"), F.when(F.col("k") % 10 == 0, "/").otherwise("")).alias("key"), F.when(F.col("k") % 13 != 0, F.to_timestamp(F.lit(NOW)) - F.make_interval(hours=(F.col("k") % 48).cast("int"))).alias("modified"))
    live = o.filter("c % 2 = 0").select(F.concat(F.lit("packs/"), F.col("k").cast("string")).alias("path"))
    before = o.filter("c % 3 = 0").select(F.concat(F.lit("places/"), F.col("k").cast("string")).alias("path"))
    now = F.to_timestamp(F.lit(NOW))
    kept = jobs.kept_paths(live, before, now - F.make_interval(hours=F.lit(3)), now, 24.0)
    return jobs.stale_keys(listing, kept, now, 24.0)


def key_difference(spark, d):
    return jobs.keys_without(_orders(spark, d, "o_custkey as k"), src.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k")), "k")


def multiset_difference(spark, d):
    li = src.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), "l_quantity", "l_discount")
    return jobs.multiset_difference(li.filter("l_quantity > 25"), li.filter("l_discount > 0.05"), ["k", "s"])


def retained_files(spark, d):
    return jobs.retained(_orders(spark, d, "o_custkey as area", "o_orderkey as version", "o_orderkey * 7919 % 100003 as seen"))


def latest_request(spark, d):
    return jobs.latest_answers(src.table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error")


def batch_plan(spark, d):
    out = jobs.batch_plan(configured_regions(spark, d).filter("place < 100"))
    return out.select("batch", "n", F.array_join("regions", ",").alias("regions"), F.array_join("sources", ",").alias("sources"))


def region_states(spark, d):
    states = src.table(spark, d, "region").filter("r_regionkey < 3").select(F.concat(F.lit("us/state-"), F.col("r_regionkey").cast("string")).alias("source"), F.col("r_name").alias("name"), F.concat(F.lit("batch-"), (F.col("r_regionkey") % 2).cast("string")).alias("batch"))
    out = jobs.region_states(configured_regions(spark, d).filter("place < 100").select(F.col("place").alias("id"), "sources"), states)
    return out.select("id", F.array_join("states", ",").alias("states"), "home", "batch")


def stalest_source(spark, d):
    stamps = src.table(spark, d, "region").filter("r_regionkey <> 3").select(F.concat(F.lit("us/state-"), F.col("r_regionkey").cast("string")).alias("source"), (F.col("r_regionkey") * 37 % 5 + 100).alias("stamp"))
    return jobs.stalest(configured_regions(spark, d).filter("place < 100").select(F.col("place").alias("id"), "sources"), stamps)


def newest_build(spark, d):
    key = F.concat(F.lpad((F.lit(20260000) + F.col("k") % 1231).cast("string"), 8, "0"), F.when(F.col("k") % 3 == 0, ".pmtiles.tmp").when(F.col("k") % 5 == 0, "x.pmtiles").otherwise(".pmtiles"))
    return jobs.newest_build(_orders(spark, d, "o_orderkey as k").select(key.alias("key")))


def outcome_report(spark, d):
    rows = _orders(spark, d, "o_orderstatus as status", "o_custkey as path", "o_custkey * 1000 % 77777 as bytes", "o_orderkey as order", "concat('r', o_orderkey) as region")
    return jobs.outcomes(rows)


def us_cameras(spark, d):
    at = src.table(spark, d, "customer").selectExpr("c_custkey as id", "c_custkey * 37 % 180 - 90 as lat", "c_custkey * 91 % 360 - 180 as lon")
    return at.filter(jobs.in_us(F.col("lat"), F.col("lon"))).select("id")


def _points(spark, d):
    return src.table(spark, d, "customer").selectExpr("c_custkey as id", "c_custkey * 37 % 4000 as x", "c_custkey * 91 % 4000 as y")


def national_split(spark, d):
    return jobs.split_by_box(_points(spark, d), (1000, 1000, 3000, 3000))


def spatial_row_sort(spark, d):
    return jobs.row_major(_points(spark, d))


def route_rows(spark, d):
    sites = F.when(F.col("id") % 4 != 0, F.transform(F.sequence(F.lit(1), (F.col("id") % 4).cast("int")), lambda i: F.col("c") + i)).otherwise(F.array().cast("array<long>"))
    routes = _orders(spark, d, "o_orderkey as id", "o_custkey as c", "cast(600 + o_orderkey % 97 as double) as time_s", "cast(3000 + o_orderkey % 1000 as double) as length_m").withColumn("sites", sites)
    return jobs.route_rows(routes).withColumns({"minutes": F.round("minutes", 6), "km": F.round("km", 6)})


def street_names_ok(spark, d):
    name = F.concat(F.when(F.col("p_partkey") % 5 == 0, F.concat((F.col("p_partkey") % 40).cast("string"), F.lit(" "))).otherwise(""), F.col("p_name"), F.when(F.col("p_partkey") % 7 == 0, ", north").otherwise(""))
    name = F.when(F.col("p_partkey") % 11 == 0, (F.col("p_partkey") % 40).cast("string")).otherwise(name)
    return src.table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name")).filter(text.plausible_street(F.col("name"))).select("id")


def other_names(spark, d):
    """Names of a street besides its main one."""
    k = F.col("p_partkey")
    names = F.array(F.col("p_name"), F.when(k % 2 == 0, "Old Road"), F.when(k % 3 == 0, F.upper("p_name")), F.when(k % 5 == 0, "old road"), F.when(k % 7 == 0, "US 75"))
    return src.table(spark, d, "part").select(k.alias("id"), text.alternatives(names, F.col("p_name")).alias("others"))


def route_sweep(spark, d):
    """Means over routed trips at each price of the sweep, against the trips' fastest paths."""
    from wayglass.operators import routing

    from . import graph_queries as gq

    prices = F.explode(F.array(*[F.lit(p) for p in (0.0, *routing.SWEEP)]))
    asked = gq.trips(spark, d, 60).withColumn("price", prices).repartition("trip_id", "price")
    found = routing.solve(asked, routing.Region(*gq.priced(spark, d))).filter("time_s > 0")
    rows = found.select(F.xxhash64("trip_id", "price").alias("id"), F.col("trip_id").alias("pair"), F.col("price").alias("lam"), F.col("time_s").alias("t"), F.col("score").alias("d"), F.col("length_m").alias("l"))
    return ev.sweep_summary(ev.with_baseline(rows, ["pair"], ["t", "d"]), ["lam"])


def experiment_summary(spark, d):
    out = ev.sweep_summary(sweep(spark, d), ["run", "lam"])
    return out.select("run", "lam", "n", *[F.round(c, 6).alias(c) for c in ("sites", "sites_median", "sites_p90", "overhead", "overhead_p90", "clear", "per_10km")])


def budget_summary(spark, d):
    best = ev.within_budgets(sweep(spark, d), ["run", "pair", "d0"])
    return ev.budget_summary(best, ["run"]).select("run", "budget", *[F.round(c, 6).alias(c) for c in ("sites", "clear", "saved")])


def budget_best(spark, d):
    return ev.within_budgets(sweep(spark, d), ["run", "pair"])


def bench_percentiles(spark, d):
    return ev.picked_percentiles(src.table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p90": 0.9}).withColumnRenamed("event_type", "kind")


def option_histogram(spark, d):
    return ev.histogram(_orders(spark, d, "o_custkey as trip", "o_orderkey % 4 as option"), "trip", "option")


def showcase_trip(spark, d):
    return ev.showcase(sweep(spark, d).filter("run = 0"))


def match_fix_to_route(spark, d):
    fixes = src.table(spark, d, "events").selectExpr("event_id", "user_id % 25 as line", "cast(event_id * 53 % 4000 as double) as x", "cast(event_id * 31 % 397 as double) as y", "cast(event_id * 7 % 3989 as double) as from_m")
    return lines.matched(fixes, polylines(spark, d)).select("event_id", F.round("along_m", 4).alias("along_m"), F.round("off_m", 4).alias("off_m"))


def tap_route(spark, d):
    taps = src.table(spark, d, "customer").selectExpr("c_custkey as tap", "c_nationkey as selected", "cast(c_custkey * 37 % 4000 as double) as x", "cast(c_custkey * 91 % 307 as double) as y")
    return lines.tapped(taps, polylines(spark, d), 60.0)


def playback_positions(spark, d):
    times = src.table(spark, d, "nation").select(F.col("n_nationkey").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("t")).withColumn("along_m", (F.col("t") * 900 + F.col("line") * 10).cast("double"))
    return lines.positions(polylines(spark, d), times).select("line", "t", *[F.round(c, 4).alias(c) for c in ("along_m", "x", "y")])


def upcoming_maneuvers(spark, d):
    return lines.upcoming(maneuvers(spark, d), driven(spark, d).select("route_id", "fix", "along_m")).select("fix", "next_step", "next_at_m", "then_step", "then_at_m")


def spoken_prompts(spark, d):
    return lines.prompts(maneuvers(spark, d), driven(spark, d))


def stop_names(spark, d):
    s = src.table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 9 != 0, (F.col("s_suppkey") % 50).cast("double")).alias("m"))
    return s.select(F.col("s_suppkey").alias("id"), lines.stop_name(F.col("s_name"), F.col("m")).alias("name"))


def held_banners(spark, d):
    e = src.table(spark, d, "events").select(F.col("user_id").alias("vehicle"), "event_id", F.timestamp_millis((F.col("event_id") * 97 % 100_000_000)).alias("ts"), F.get(F.array(*[F.lit(s) for s in ("clear", "ahead", "ring", "zone", "clear")]), (F.col("event_id") % 5).cast("int")).alias("state"))
    rank = F.when(F.col("state") == "zone", 3).when(F.col("state") == "ring", 2).otherwise(0)
    return lines.held(e, rank).select("event_id", "state", "shown")


QUERIES = {
    f.__name__: f
    for f in (
        tile_dedupe, feed_gate, region_validate, listing_parse, release_paths, manifest_merge, manifest_reuse, prune_keys, key_difference, multiset_difference, retained_files, latest_request, batch_plan, region_states, stalest_source, newest_build, outcome_report,
        us_cameras, national_split, spatial_row_sort, route_rows, street_names_ok, other_names, route_sweep, experiment_summary, budget_summary, budget_best, bench_percentiles, option_histogram, showcase_trip, match_fix_to_route, tap_route, playback_positions, upcoming_maneuvers, spoken_prompts, stop_names, held_banners,
    )
}

# ----------------------------------------------------------------------------------------------- SQL

REGIONS = """
    cfg AS (SELECT n_nationkey + again AS place, n_nationkey AS k, n_regionkey AS batch, CASE WHEN n_nationkey % 8 = 3 THEN n_name ELSE lower(replace(n_name, ' ', '-')) END AS id, n_nationkey * 7 - 100 AS w, n_nationkey - 20 AS s,
        n_nationkey * 7 - 100 + n_nationkey % 5 * 2 AS e, n_nationkey - 20 + n_nationkey % 6 AS n, list_transform(range(0, n_nationkey % 3 + 1), lambda i: 'us/state-' || ((n_nationkey + i * (n_nationkey % 2)) % 4)) AS src
        FROM nation, (VALUES (0), (100)) v(again) WHERE again = 0 OR n_regionkey = 1)"""
SWEEP = """
    raw AS (SELECT o_orderkey AS id, o_orderkey % 2 AS run, o_custkey AS pair, o_orderkey // 2 % 6 * 30 AS lam, CAST(600 + o_orderkey % 97 AS DOUBLE) AS t, o_orderkey * 7 % 11 AS d, 3000 + o_orderkey % 1000 AS l FROM orders),
    base AS (SELECT * FROM raw WHERE lam = 0 QUALIFY row_number() OVER (PARTITION BY run, pair ORDER BY id) = 1),
    sw AS (SELECT raw.*, base.t AS t0, base.d AS d0, raw.t / base.t - 1 AS over FROM raw LEFT JOIN base ON base.run = raw.run AND base.pair = raw.pair)"""
LINES = """
    pts AS (SELECT n_nationkey AS line, k, CAST(k * 500 + n_nationkey * 13 % 7 * 10 AS DOUBLE) AS x, CAST((n_nationkey * 7 + k * 3) % 5 * 60 + n_nationkey AS DOUBLE) AS y FROM nation, range(0, 9) r(k)),
    seg AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM (SELECT line, k, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM pts WINDOW w AS (PARTITION BY line ORDER BY k)) WHERE x1 IS NOT NULL),
    sg AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS from_m FROM seg)"""
STEPS = "st AS (SELECT n_nationkey AS route_id, step, CASE step WHEN 0 THEN 'depart' WHEN 6 THEN 'arrive' ELSE 'turn' END AS kind, CAST(step * 600 - CASE WHEN step % 2 = 0 THEN n_nationkey * 25 ELSE 0 END AS DOUBLE) AS at_m FROM nation, range(0, 7) r(step))"
DRIVEN = "dr AS (SELECT user_id % 25 AS route_id, event_id AS fix, CAST(event_id * 53 % 4000 AS DOUBLE) AS along_m, event_id % 35 AS speed FROM events)"
T = "least(1, greatest(0, ((p.x - x0) * (x1 - x0) + (p.y - y0) * (y1 - y0)) / (len * len)))"
OFF = "sqrt(power(x0 + t * (x1 - x0) - x, 2) + power(y0 + t * (y1 - y0) - y, 2))"

ORACLES = {
    "tile_dedupe": "SELECT id, tile FROM (SELECT o_custkey AS id, o_orderkey % 18 AS tile, o_orderkey AS k FROM orders) QUALIFY row_number() OVER (PARTITION BY id ORDER BY tile DESC, k DESC) = 1",
    "feed_gate": """WITH f AS (SELECT c_nationkey AS region, count(*) AS n FROM customer WHERE c_nationkey % 9 <> 4 AND c_custkey % (c_nationkey % 4 + 1) = 0 GROUP BY 1), b AS (SELECT c_nationkey AS region, count(*) AS was FROM customer WHERE c_nationkey % 7 <> 6 GROUP BY 1)
        SELECT region, coalesce(n, 0) AS n, was, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n * 2 < was THEN 'shrunk' ELSE 'ok' END AS gate FROM f FULL JOIN b USING (region)""",
    "region_validate": f"""WITH {REGIONS} SELECT place, id, array_to_string(list_filter([CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' END, CASE WHEN e <= w OR n <= s OR w < -180 OR e > 180 OR s < -90 OR n > 90 THEN 'bad box' END,
        CASE WHEN len(src) = 0 OR len(list_distinct(src)) <> len(src) THEN 'bad sources' END, CASE WHEN NOT regexp_full_match(id, '[a-z0-9-]+') OR replace(id, '-', '') = '' THEN 'bad id' END], lambda x: x IS NOT NULL), ', ') AS problems FROM cfg""",
    "listing_parse": "SELECT o_orderkey AS id, 'packs/' || o_custkey || '.fwr' AS key, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN '1998-01-02 03:04:05' END AS modified FROM orders WHERE o_orderkey % 17 <> 0",
    "release_paths": "SELECT lower(replace(n_name, ' ', '-')) AS region, 'packs/' || lower(replace(n_name, ' ', '-')) || '.' || left(sha256(n_name), 10) || '.fwr' AS path FROM nation",
    "manifest_merge": """SELECT c_custkey AS id, c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 100 ELSE 0 END AS version, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 11 = 0 THEN 'old' ELSE 'b' || c_custkey END AS basemap, CASE WHEN c_custkey % 3 = 0 THEN 'live' ELSE 'fresh' END AS origin, c_custkey AS place
        FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND (c_custkey % 3 <> 0 OR c_custkey % 4 <> 0) AND (c_custkey % 11 <> 0 OR (c_custkey % 3 = 0 AND c_custkey % 2 = 1))""",
    "manifest_reuse": "SELECT c_custkey AS id, CASE c_custkey % 2 WHEN 0 THEN 'pack' ELSE 'places' END AS kind, CASE WHEN same THEN 'live/' ELSE 'new/' END || c_custkey AS path, same AS reused FROM (SELECT *, c_custkey % 5 <> 0 AND c_nationkey % 6 = c_custkey % 6 AS same FROM customer)",
    "prune_keys": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, ['packs/', 'basemap/', 'places/', 'basemap/assets/', 'cameras/', 'packs/'][o_orderkey % 6 + 1] || o_orderkey || CASE WHEN o_orderkey % 10 = 0 THEN '/' ELSE '' END AS key FROM orders),
        kept AS (SELECT 'packs/' || k AS key FROM o WHERE c % 2 = 0 UNION SELECT 'places/' || k FROM o WHERE c % 3 = 0)
        SELECT key FROM o WHERE k % 6 NOT IN (3, 4) AND k % 10 <> 0 AND k % 13 <> 0 AND k % 48 >= 24 AND key NOT IN (SELECT key FROM kept)""",
    "key_difference": "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0",
    "multiset_difference": "SELECT k, s, count(*) AS n FROM (SELECT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_quantity > 25 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.05) GROUP BY k, s",
    "retained_files": "SELECT area, version FROM (SELECT o_custkey AS area, max(o_orderkey) AS version, max(o_orderkey * 7919 % 100003) AS seen FROM orders GROUP BY o_custkey) ORDER BY seen DESC, area LIMIT 4",
    "latest_request": "SELECT DISTINCT user_id AS session, last_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS answered FROM events WHERE event_type <> 'error'",
    "batch_plan": f"""WITH {REGIONS}, c AS (SELECT * FROM cfg WHERE place < 100), u AS (SELECT batch, s, min(place * 100 + i) AS pos FROM (SELECT batch, place, unnest(src) AS s, unnest(range(1, len(src) + 1)) AS i FROM c) GROUP BY 1, 2)
        SELECT c.batch, count(*) AS n, string_agg(id, ',' ORDER BY place) AS regions, any_value((SELECT string_agg(s, ',' ORDER BY pos) FROM u WHERE u.batch = c.batch)) AS sources FROM c GROUP BY c.batch""",
    "region_states": f"""WITH {REGIONS}, x AS (SELECT place, unnest(src) AS s, unnest(range(1, len(src) + 1)) AS i FROM cfg WHERE place < 100), y AS (SELECT x.*, r_name, r_regionkey FROM x LEFT JOIN region ON s = 'us/state-' || r_regionkey AND r_regionkey < 3)
        SELECT place AS id, coalesce(string_agg(r_name, ',' ORDER BY i), '') AS states, max(CASE WHEN i = 1 THEN coalesce(r_name, 'State ' || right(s, 1)) END) AS home, coalesce(max(CASE WHEN i = 1 THEN 'batch-' || (r_regionkey % 2) END), 'other') AS batch FROM y GROUP BY place""",
    "stalest_source": f"WITH {REGIONS}, x AS (SELECT place, unnest(src) AS s FROM cfg WHERE place < 100) SELECT place AS id, min(CASE WHEN r_regionkey <> 3 THEN r_regionkey * 37 % 5 + 100 END) AS as_of FROM x LEFT JOIN region ON s = 'us/state-' || r_regionkey GROUP BY place",
    "newest_build": "SELECT max(CAST(20260000 + o_orderkey % 1231 AS VARCHAR)) AS build FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0",
    "outcome_report": """WITH p AS (SELECT DISTINCT o_orderstatus AS status, o_custkey, o_custkey * 1000 % 77777 AS bytes FROM orders), h AS (SELECT o_orderstatus AS status, 'r' || o_orderkey AS heaviest FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey * 1000 % 77777 DESC, o_orderkey) = 1)
        SELECT o_orderstatus AS status, count(*) AS n, any_value(heaviest) AS heaviest, any_value(b) AS bytes FROM orders JOIN h ON h.status = o_orderstatus JOIN (SELECT status, CAST(sum(bytes) AS BIGINT) AS b FROM p GROUP BY status) t ON t.status = o_orderstatus GROUP BY o_orderstatus""",
    "us_cameras": "SELECT id FROM (SELECT c_custkey AS id, c_custkey * 37 % 180 - 90 AS lat, c_custkey * 91 % 360 - 180 AS lon FROM customer) WHERE lat BETWEEN 24 AND 50 AND lon BETWEEN -125 AND -66 OR lat BETWEEN 51 AND 72 AND lon BETWEEN -180 AND -129 OR lat BETWEEN 18 AND 23 AND lon BETWEEN -161 AND -154",
    "national_split": "SELECT CASE WHEN x >= 1000 AND x <= 3000 AND y >= 1000 AND y <= 3000 THEN 'inside' ELSE 'outside' END AS side, count(*) AS n, min(id) AS first FROM (SELECT c_custkey AS id, c_custkey * 37 % 4000 AS x, c_custkey * 91 % 4000 AS y FROM customer) GROUP BY 1",
    "spatial_row_sort": "SELECT c_custkey AS id, c_custkey * 91 % 4000 // 1000 AS row, rank() OVER (PARTITION BY c_custkey * 91 % 4000 // 1000 ORDER BY c_custkey * 37 % 4000, c_custkey * 91 % 4000, c_custkey) AS i FROM customer",
    "route_rows": "SELECT o_orderkey AS id, round((600 + o_orderkey % 97) / 60, 6) AS minutes, round((3000 + o_orderkey % 1000) / 1000, 6) AS km, o_orderkey % 4 AS n_sites, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey + 1 END AS first_site FROM orders",
    "street_names_ok": "SELECT p_partkey AS id FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND regexp_matches(p_name, '[A-Za-z]')",
    "other_names": "SELECT p_partkey AS id, concat_ws(' · ', CASE WHEN p_partkey % 2 = 0 THEN 'Old Road' WHEN p_partkey % 5 = 0 THEN 'old road' END, CASE WHEN p_partkey % 7 = 0 THEN 'US 75' END) AS others FROM part",
    "experiment_summary": f"""WITH {SWEEP} SELECT run, lam, count(*) AS n, round(avg(d), 6) AS sites, round(median(d), 6) AS sites_median, round(quantile_cont(d, 0.9), 6) AS sites_p90, round(avg(over), 6) AS overhead, round(quantile_cont(over, 0.9), 6) AS overhead_p90, round(count(*) FILTER (d = 0) / count(*), 6) AS clear,
        round(10000 * sum(d) / sum(l), 6) AS per_10km FROM sw GROUP BY run, lam""",
    "budget_summary": f"""WITH {SWEEP}, m AS (SELECT run, pair, d0, budget, min(CASE WHEN over <= budget + 0.000000001 THEN d END) AS sites FROM sw, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE)) b(budget) GROUP BY ALL)
        SELECT run, budget, round(avg(sites), 6) AS sites, round(avg(CASE WHEN sites = 0 THEN 1 WHEN sites > 0 THEN 0 END), 6) AS clear, round(1 - avg(sites) / avg(d0), 6) AS saved FROM m GROUP BY run, budget""",
    "budget_best": f"WITH {SWEEP} SELECT run, pair, budget, min(CASE WHEN over <= budget + 0.000000001 THEN d END) AS sites FROM sw, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE)) b(budget) GROUP BY run, pair, budget",
    "bench_percentiles": "SELECT event_type AS kind, list_sort(list(value))[1 + least(count(*) - 1, CAST(floor(0.5 * count(*)) AS BIGINT))] AS p50, list_sort(list(value))[1 + least(count(*) - 1, CAST(floor(0.9 * count(*)) AS BIGINT))] AS p90 FROM events GROUP BY event_type",
    "option_histogram": "SELECT options, count(*) AS trips FROM (SELECT len(list_distinct(list(o_orderkey % 4))) AS options FROM orders GROUP BY o_custkey) GROUP BY options",
    "showcase_trip": f"""WITH {SWEEP}, c AS (SELECT * FROM sw WHERE run = 0 AND lam > 0 AND over <= 0.1 AND d0 >= 4 QUALIFY row_number() OVER (PARTITION BY pair ORDER BY d, over, id) = 1) SELECT pair, lam, d0 - d AS gain FROM c ORDER BY gain DESC, pair LIMIT 1""",
    "match_fix_to_route": f"""WITH {LINES}, p AS (SELECT event_id, user_id % 25 AS line, CAST(event_id * 53 % 4000 AS DOUBLE) AS x, CAST(event_id * 31 % 397 AS DOUBLE) AS y, CAST(event_id * 7 % 3989 AS DOUBLE) AS since FROM events),
        m AS (SELECT p.*, sg.* EXCLUDE (line), {T} AS t FROM p JOIN sg ON sg.line = p.line), o AS (SELECT *, {OFF} AS off, from_m + t * len AS along FROM m)
        SELECT event_id, round(along, 4) AS along_m, round(off, 4) AS off_m FROM o QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY off + greatest(0, since - 40 - along), k) = 1""",
    "tap_route": f"""WITH {LINES}, p AS (SELECT c_custkey AS tap, c_nationkey AS selected, CAST(c_custkey * 37 % 4000 AS DOUBLE) AS x, CAST(c_custkey * 91 % 307 AS DOUBLE) AS y FROM customer), m AS (SELECT p.*, sg.*, {T} AS t FROM p JOIN sg ON line <> selected), o AS (SELECT tap, line, round({OFF}, 6) AS off FROM m)
        SELECT tap, line FROM o WHERE off <= 60 QUALIFY row_number() OVER (PARTITION BY tap ORDER BY off, line DESC) = 1""",
    "playback_positions": f"""WITH {LINES}, e AS (SELECT line, max(from_m + len) AS total FROM sg GROUP BY line), w AS (SELECT n_nationkey AS line, t, least(CAST(t * 900 + n_nationkey * 10 AS DOUBLE), total) AS d FROM nation, range(0, 6) r(t), e WHERE e.line = n_nationkey)
        SELECT w.line, t, round(d, 4) AS along_m, round(x0 + (d - from_m) / len * (x1 - x0), 4) AS x, round(y0 + (d - from_m) / len * (y1 - y0), 4) AS y FROM w JOIN sg ON sg.line = w.line AND from_m <= d QUALIFY row_number() OVER (PARTITION BY w.line, t ORDER BY k DESC) = 1""",
    "upcoming_maneuvers": f"""WITH {STEPS}, {DRIVEN} SELECT fix, (SELECT min(step) FROM st WHERE st.route_id = dr.route_id AND kind <> 'depart' AND at_m > along_m) AS next_step, (SELECT min_by(at_m, step) FROM st WHERE st.route_id = dr.route_id AND kind <> 'depart' AND at_m > along_m) AS next_at_m,
        (SELECT min(step) + 1 FROM st WHERE st.route_id = dr.route_id AND kind <> 'depart' AND at_m > along_m HAVING min(step) < 6) AS then_step, (SELECT at_m FROM st WHERE st.route_id = dr.route_id AND step = (SELECT min(step) + 1 FROM st z WHERE z.route_id = dr.route_id AND z.kind <> 'depart' AND z.at_m > along_m)) AS then_at_m FROM dr""",
    "spoken_prompts": f"""WITH {STEPS}, {DRIVEN}, n AS (SELECT dr.route_id, fix, step, at_m - along_m AS left_m, lead(at_m) OVER w - at_m AS gap, CASE WHEN speed > 1 THEN speed ELSE 12 END AS v, row_number() OVER (PARTITION BY fix ORDER BY step) AS i FROM dr JOIN st ON st.route_id = dr.route_id AND kind <> 'depart' WINDOW w AS (PARTITION BY fix ORDER BY step)),
        a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fix ORDER BY step) AS j FROM n WHERE left_m > 0) WHERE j = 1), b AS (SELECT *, least(250, greatest(40, v * 7)) AS near, least(1600, greatest(250, v * 30)) AS far FROM a),
        nw AS (SELECT * FROM b WHERE left_m <= near QUALIFY row_number() OVER (PARTITION BY route_id, step ORDER BY fix) = 1), ea AS (SELECT * FROM b WHERE left_m > near AND left_m <= far QUALIFY row_number() OVER (PARTITION BY route_id, step ORDER BY fix) = 1)
        SELECT route_id, step, 'now' AS said, fix FROM nw UNION ALL SELECT route_id, step, 'early', fix FROM ea WHERE left_m > 1.5 * near AND NOT EXISTS (SELECT 1 FROM nw WHERE nw.route_id = ea.route_id AND nw.fix <= ea.fix AND (nw.step = ea.step OR nw.step = ea.step - 1 AND nw.gap <= 200))""",
    "stop_names": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 <> 0 AND s_suppkey % 50 >= 25 THEN 'Near ' ELSE '' END || s_name AS name FROM supplier",
    "held_banners": """WITH e AS (SELECT event_id, user_id, event_id * 97 % 100000000 AS ms, ['clear', 'ahead', 'ring', 'zone', 'clear'][event_id % 5 + 1] AS state, [0, 0, 2, 3, 0][event_id % 5 + 1] AS r FROM events),
        x AS (SELECT a.event_id, a.state, a.r, max(b.r) AS top FROM e a JOIN e b ON a.user_id = b.user_id AND b.ms <= a.ms AND b.ms > a.ms - 1500 GROUP BY ALL) SELECT event_id, state, CASE WHEN top > r THEN CASE top WHEN 3 THEN 'zone' ELSE 'ring' END ELSE state END AS shown FROM x""",
}
