"""Queries over versions, feeds, evaluations and fixes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayglass.operators import release as rl
from wayglass.operators.evaluate import picked_percentiles
from wayglass.sources import adapters as src


def _orders(spark, d, fresh: bool) -> DataFrame:
    """A version of road edges: region, key; the fresh one lost some and gained others."""
    o = src.table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("region"), (F.col("o_orderkey") % 5000).alias("key"), F.col("o_orderkey").alias("id"))
    if fresh:
        return o.filter("id % 97 <> 0 or region % 3 <> 0").withColumn("key", F.expr("case when id % 61 = 0 and region % 4 = 1 then key + 10000 else key end"))
    return o.filter("region <> 7")


def version_diff(spark, d):
    return rl.changed_share(_orders(spark, d, True), _orders(spark, d, False), ["region"], "key").withColumn("changed", F.round("changed", 6))


def verify_verdict(spark, d):
    share = rl.changed_share(_orders(spark, d, True), _orders(spark, d, False), ["region"], "key")
    t = _orders(spark, d, True).select("region", F.when(F.col("id") % 50 == 3, None).otherwise(0.6 + F.col("id") % 41 * 0.025).alias("ratio"))
    trips = t.groupBy("region").agg((F.count_if(rl.is_outlier(F.col("ratio"))) / F.count("ratio")).alias("outliers"), (F.count_if(F.col("ratio").isNull()) / F.count(F.lit(1))).alias("lost"))
    trips = trips.join(picked_percentiles(t, "region", "ratio", {"median": 0.5}), "region", "left")  # the element in the middle, the upper one of two
    return share.join(trips, "region").select("region", F.array_join(rl.verdict(F.col("n_fresh"), F.nullif(F.col("n_live"), F.lit(0)), F.col("median"), F.col("outliers"), F.col("lost")), ", ").alias("reasons"), F.round("median", 4).alias("median"))


def publish_decision(spark, d):
    s = rl.changed_share(_orders(spark, d, True), _orders(spark, d, False), ["region"], "key")
    r = F.col("region")
    age = F.when(r % 5 != 0, r % 9)
    return s.select("region", rl.decision(F.col("changed") == 0, r % 11 != 5, F.col("n_live") > 0, r % 13 == 12, F.col("changed"), age).alias("decision"))


def fingerprint(spark, d):
    return rl.fingerprint(_orders(spark, d, True), "region", F.col("key"))


def delta_encode(spark, d):
    return rl.delta(_orders(spark, d, False), "region", "id", "key").select("region", "id", "delta")


def delta_decode(spark, d):
    return rl.undelta(rl.delta(_orders(spark, d, False), "region", "id", "key"), "region", "id").select("region", "id", "value")


def merge_versions(spark, d):
    o = src.table(spark, d, "orders").select((F.col("o_orderkey") % 3000).alias("object"), F.col("o_orderkey").alias("version"), "o_orderstatus")
    return rl.newest(o, ["object"], [F.col("version")])


def fix_progress(spark, d):
    f = src.fixes(spark, d).select("vehicle", "ts", "event_id", "x")
    return rl.progress(f.withColumnRenamed("x", "along")).select("event_id", "furthest")


def off_route_runs(spark, d):
    f = src.fixes(spark, d).select("vehicle", "ts", "event_id", (F.col("x") % 700).alias("off_m"), "accuracy")
    return rl.off_route(f).select("event_id", "strikes", "reroute")


def zone_alerts(spark, d):
    """What a driver is told at each fix: zone before ring before ahead, by the stretch driven since the fix before."""
    w = Window.partitionBy("vehicle").orderBy("ts", "event_id")
    f = src.fixes(spark, d).select("vehicle", "ts", "event_id", F.col("x").alias("at"), "speed")
    vehicles = f.agg(F.count_distinct("vehicle")).first()[0] or 1
    f = f.withColumn("last", F.lag("at", 1, 0.0).over(w)).filter("at > last")
    zones = src.cameras(spark, d).select((F.col("id") % vehicles).alias("vehicle"), F.col("x").alias("a"), (F.col("x") + 60).alias("b"))  # of the route that each vehicle follows
    ahead = F.greatest(F.lit(400.0), 25 * F.col("speed"))
    hit = f.join(zones, "vehicle").filter((F.col("a") <= F.col("at") + ahead) & (F.col("b") + 100 > F.col("last")))
    level = F.when((F.col("a") <= F.col("at")) & (F.col("b") > F.col("last")), 3).when((F.col("a") - 100 <= F.col("at")) & (F.col("b") + 100 > F.col("last")), 2).otherwise(1)
    best = hit.groupBy("event_id").agg(F.max(level).alias("level"))
    return f.join(best, "event_id", "left").select("event_id", F.when(F.col("level") == 3, "zone").when(F.col("level") == 2, "ring").when(F.col("level") == 1, "ahead").otherwise("clear").alias("state"))


def live_alerts_stream(spark, d):
    """Alerts of a stream of fixes along one route: keyed state, file sink in the shared folder, all that is available."""
    import uuid

    from wayglass.plans.iterate import shared_folder
    from wayglass.streaming import vehicles

    folder = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    schema = src.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    fixes = events.select(F.col("user_id").alias("vehicle"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 4000).cast("double").alias("along"), (F.col("event_id") % 120).cast("double").alias("off_m"), F.col("value").alias("speed"), (F.col("event_id") % 40).cast("double").alias("accuracy"))
    zones = [(site, 300.0 * site, 300.0 * site + 60) for site in range(12)]
    query = vehicles.alerts(fixes, zones, 4000.0).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(vehicles.ALERTS).parquet(f"{folder}/out")


QUERIES = {f.__name__: f for f in (version_diff, verify_verdict, publish_decision, fingerprint, delta_encode, delta_decode, merge_versions, fix_progress, off_route_runs, zone_alerts, live_alerts_stream)}

VERSIONS = """
    liv AS (SELECT o_custkey % 40 AS region, o_orderkey % 5000 AS key, o_orderkey AS id FROM orders WHERE o_custkey % 40 <> 7),
    fre AS (SELECT o_custkey % 40 AS region, CASE WHEN o_orderkey % 61 = 0 AND o_custkey % 40 % 4 = 1 THEN o_orderkey % 5000 + 10000 ELSE o_orderkey % 5000 END AS key, o_orderkey AS id FROM orders WHERE o_orderkey % 97 <> 0 OR o_custkey % 40 % 3 <> 0),
    cmp AS (SELECT region, sum(a) AS n_fresh, sum(b) AS n_live, sum(abs(a - b)) / greatest(1, sum(a) + sum(b)) AS changed FROM (SELECT coalesce(f.region, l.region) AS region, coalesce(a, 0) AS a, coalesce(b, 0) AS b
        FROM (SELECT region, key, count(*) AS a FROM fre GROUP BY 1, 2) f FULL JOIN (SELECT region, key, count(*) AS b FROM liv GROUP BY 1, 2) l ON f.region = l.region AND f.key = l.key) GROUP BY region)"""
FIX = "fx AS (SELECT event_id, user_id AS vehicle, ts, CAST((event_id * 53) % 4000 AS DOUBLE) AS x, CAST(event_id % 200 AS DOUBLE) AS accuracy, value AS speed FROM events)"

ORACLES = {
    "version_diff": f"WITH {VERSIONS} SELECT region, CAST(n_fresh AS BIGINT) AS n_fresh, CAST(n_live AS BIGINT) AS n_live, round(changed, 6) AS changed FROM cmp",
    "verify_verdict": f"""WITH {VERSIONS}, t AS (SELECT region, CASE WHEN id % 50 <> 3 THEN 0.6 + id % 41 * 0.025::DOUBLE END AS ratio FROM fre), r AS (SELECT region, list_sort(list(ratio) FILTER (ratio IS NOT NULL))[count(ratio) // 2 + 1] AS median, count(*) FILTER (ratio > 1.5 OR ratio * 1.5 < 1) / count(ratio) AS o, count(*) FILTER (ratio IS NULL) / count(*) AS l FROM t GROUP BY region)
        SELECT region, array_to_string(list_filter([CASE WHEN n_fresh < 100 THEN 'too few edges' END, CASE WHEN n_live > 0 AND (n_fresh / n_live < 0.85 OR n_fresh / n_live > 1.2) THEN 'number of edges' END, CASE WHEN median < 0.85 OR median > 1.15 THEN 'travel times' END, CASE WHEN o > 0.1 THEN 'outliers' END, CASE WHEN l > 0.05 THEN 'lost trips' END], lambda x: x IS NOT NULL), ', ') AS reasons, round(median, 4) AS median FROM cmp JOIN r USING (region)""",
    "publish_decision": f"WITH {VERSIONS} SELECT region, CASE WHEN n_live > 0 AND changed = 0 THEN 'unchanged' WHEN region % 11 = 5 THEN 'hold' WHEN n_live = 0 OR region % 13 = 12 OR changed >= 0.01 OR region % 5 = 0 OR region % 9 >= 7 THEN 'publish' ELSE 'defer' END AS decision FROM cmp",
    "fingerprint": f"WITH {VERSIONS} SELECT region, sha256(string_agg(CAST(key AS VARCHAR), ',' ORDER BY CAST(key AS VARCHAR))) AS fingerprint FROM fre GROUP BY region",
    "delta_encode": f"WITH {VERSIONS} SELECT region, id, key - lag(key, 1, 0) OVER (PARTITION BY region ORDER BY id) AS delta FROM liv",
    "delta_decode": f"WITH {VERSIONS} SELECT region, id, key AS value FROM liv",
    "merge_versions": "SELECT o_orderkey % 3000 AS object, o_orderkey AS version, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 3000 ORDER BY o_orderkey DESC) = 1",
    "fix_progress": f"WITH {FIX} SELECT event_id, max(x) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS furthest FROM fx",
    "off_route_runs": f"WITH {FIX}, b AS (SELECT *, x % 700 > greatest(45, 1.5 * accuracy) AND accuracy < 150 AS bad FROM fx), r AS (SELECT *, count(*) FILTER (NOT bad) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b), s AS (SELECT event_id, count(*) FILTER (bad) OVER (PARTITION BY vehicle, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS strikes FROM r) SELECT event_id, strikes, strikes >= 3 AS reroute FROM s",
    "zone_alerts": f"WITH ext AS (SELECT 1), {FIX}, f AS (SELECT * FROM (SELECT *, lag(x, 1, 0) OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS last FROM fx) WHERE x > last), z AS (SELECT c_custkey % (SELECT count(DISTINCT user_id) FROM events) AS vehicle, (CASE WHEN (c_custkey // 3) % 2 = 0 THEN 3 * (c_custkey // 3) ELSE c_custkey END * 37) % 4000 + CASE WHEN (c_custkey // 3) % 2 = 0 THEN (c_custkey % 3) * 20 ELSE 0 END AS a FROM customer),"
    " h AS (SELECT event_id, max(CASE WHEN a <= x AND a + 60 > last THEN 3 WHEN a - 100 <= x AND a + 160 > last THEN 2 ELSE 1 END) AS level FROM f JOIN z ON f.vehicle = z.vehicle AND a <= x + greatest(400, 25 * speed) AND a + 160 > last GROUP BY event_id) SELECT event_id, CASE level WHEN 3 THEN 'zone' WHEN 2 THEN 'ring' WHEN 1 THEN 'ahead' ELSE 'clear' END AS state FROM f LEFT JOIN h USING (event_id)",
}
