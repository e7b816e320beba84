"""Queries over cameras and their exposure, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayglass.functions import geo
from wayglass.operators import cameras as cam
from wayglass.operators.evaluate import medians
from wayglass.operators.proximity import nearest_at_any_distance, proximity_join
from wayglass.sources import adapters as src
from wayglass.streaming.exposure import ExposureView

from .iterate import cut, scratch_path


def segments(spark: SparkSession, d: str) -> DataFrame:
    return src.road_geoms(spark, d).select("geom_id", F.lit(0).alias("k"), "ax", "ay", "bx", "by", F.lit(0.0).alias("s0"), F.lit(True).alias("is_last"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """edge_id, geom_id, rev, src, dst, len, class, kmh, time_s, heading, name: legal directions of travel; sinks have no way out."""
    g = src.road_geoms(spark, d)
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    both = g.withColumn("rev", F.explode(F.array(F.lit(False), F.lit(True)))).filter("not rev or not one_way")
    out = both.withColumns({"src": F.expr("if(rev, v, u)"), "dst": F.expr("if(rev, u, v)"), "len": length})
    head = geo.bearing(F.expr("if(rev, ax - bx, bx - ax)"), F.expr("if(rev, ay - by, by - ay)"))
    out = out.withColumn("heading", F.pmod(F.round(head * 100), F.lit(36000.0)) / 100)
    signal = F.expr("if(rev, u_signal, v_signal)")
    return out.filter("src % 53 <> 7").select(
        (F.col("geom_id") * 2 + F.col("rev").cast("int")).alias("edge_id"), "geom_id", "rev", "src", "dst", "len", "class", "kmh",
        (F.col("len") / (F.col("kmh") / 3.6) + F.when(signal, 8.0).otherwise(0.0)).alias("time_s"), "heading", "name",
    )


def _exposure(spark: SparkSession, d: str, params=geo.PROFILES["default"], both_ways: bool = False) -> DataFrame:
    c = src.cameras(spark, d)
    return cam.exposure(segments(spark, d), edges(spark, d), cam.camera_zones(c, params, both_ways), cam.capture_sites(c))


def camera_direction_parse(spark, d):
    c = src.cameras(spark, d)
    return c.select("id", F.posexplode_outer(geo.parse_direction("direction")).alias("k", "s")).select("id", "k", F.round("s.bearing", 4).alias("bearing"), F.round("s.extra", 4).alias("extra"))


def direction_quality(spark, d):
    n = src.cameras(spark, d).groupBy(geo.direction_quality("direction").alias("quality")).agg(F.count(F.lit(1)).alias("n"))
    total = src.cameras(spark, d).count()
    return n.withColumn("pct", F.round(F.col("n") * 100 / F.lit(total), 4))


def camera_zones(spark, d):
    z = cam.camera_zones(src.cameras(spark, d))
    return z.select("id", "mode", F.size("sectors").alias("n_sectors"), F.round(F.get("sectors", F.lit(0))["half_angle"], 4).alias("half_angle"), "range_m", "eps_m", "tol")


def zone_reference(spark, d):
    parts = [cam.camera_zones(src.cameras(spark, d), p).groupBy("ref_m").agg(F.count(F.lit(1)).alias("n")).withColumn("profile", F.lit(k)) for k, p in geo.PROFILES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sector_distance_grid(spark, d):
    c = src.table(spark, d, "customer").selectExpr("c_custkey as id", "cast(c_custkey % 41 * 7 - 140 + 0.5 as double) as px", "cast(c_custkey % 37 * 9 - 160 + 0.25 as double) as py", "cast(c_custkey % 24 * 15 + 1 as double) as b")
    return c.select("id", F.round(geo.sector_distance("px", "py", "b", F.lit(30.0), F.lit(50.0)), 6).alias("dist"))


def capture_predicate(spark, d):
    c = src.table(spark, d, "customer").selectExpr("c_custkey as id", "cast(c_custkey % 41 * 4 - 80 + 0.5 as double) as px", "cast(c_custkey % 37 * 5 - 90 + 0.25 as double) as py", "cast(c_custkey % 24 * 15 + 1 as double) as b", "cast(c_custkey % 72 * 5 + 2 as double) as heading")
    one = F.array(F.struct(F.col("b").alias("bearing"), F.lit(30.0).alias("half_angle")))
    return c.select("id", *[geo.captures("px", "py", "heading", F.lit(m), one, F.lit(50.0), F.lit(12.0), F.lit(45.0)).alias(f"by_{m}") for m in ("any", "rear", "axis")])


def camera_site_pairs(spark, d):
    return cam.site_pairs(src.cameras(spark, d))


def capture_sites(spark, d):
    return cam.capture_sites(src.cameras(spark, d))


def edge_exposure(spark, d):
    return _exposure(spark, d).select("edge_id", "site", F.round("entry_m", 4).alias("entry_m"), F.round("exit_m", 4).alias("exit_m"), F.round("units", 6).alias("units"), "at_end")


def exposure_after_changes(spark, d):
    """Exposure kept up to date over two batches: first every tenth camera stands 500 m off and every fifteenth has a double at its side; then those move and the doubles go."""
    c = src.cameras(spark, d).select("id", "x", "y", "direction", "brand")
    say = lambda rows, version, gone=False: rows.withColumns({"version": F.lit(version).cast("long"), "deleted": F.lit(gone)})
    doubles = c.filter("id % 15 = 1").withColumn("id", -F.col("id"))
    view = ExposureView(spark, scratch_path(spark, "exposure"), segments(spark, d), edges(spark, d))
    view.apply(say(c.withColumn("x", F.expr("if(id % 10 = 3, x + 500, x)")).unionByName(doubles), 1), 1)
    view.apply(say(c.filter("id % 10 = 3"), 2).unionByName(say(doubles, 2, True)), 2)
    return view.exposure().select("edge_id", "site", F.round("entry_m", 4).alias("entry_m"), F.round("exit_m", 4).alias("exit_m"), F.round("units", 6).alias("units"), "at_end")


def exposure_totals(spark, d):
    return _exposure(spark, d).groupBy("edge_id").agg(F.count(F.lit(1)).alias("sites"), F.round(F.sum("units"), 6).alias("units"))


def edge_exposure_rings(spark, d):
    both = cam.with_rings(_exposure(spark, d), _exposure(spark, d, geo.RINGS["default"], True))
    return both.groupBy("edge_id", "layer").agg(F.count(F.lit(1)).alias("sites"), F.round(F.sum("weight"), 4).alias("weight"))


def near_only_sites(spark, d):
    zone, ring = _exposure(spark, d), _exposure(spark, d, geo.RINGS["default"], True)
    return ring.join(zone, ["edge_id", "site"], "left_anti").select("edge_id", "site")


def segment_zone_join(spark, d):
    z = cam.camera_zones(src.cameras(spark, d)).select("id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    s = cam.samples(segments(spark, d)).select("geom_id", "j", "x", "y")
    return proximity_join(s, z, 62.0).groupBy("id").agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("geom_id").alias("n_geoms"))


def orphan_cameras(spark, d):
    c = src.cameras(spark, d)
    z, sites = cam.camera_zones(c), c.select("id", F.col("id").alias("site"))
    anyway = cam.camera_zones(c, omni=True)
    hit = cam.exposure(segments(spark, d), edges(spark, d), z, sites).select(F.col("site").alias("id")).distinct().withColumn("hit", F.lit(True))
    loose = cam.exposure(segments(spark, d), edges(spark, d), anyway, sites).select(F.col("site").alias("id")).distinct().withColumn("loose", F.lit(True))
    kind = F.when(F.col("hit"), "captured").when(F.col("loose"), "bearing mismatch").otherwise("off network")
    return c.join(hit, "id", "left").join(loose, "id", "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def orphan_report(spark, d):
    """Cameras by what they capture: how many, how many of them would if headings were ignored, the median distance to the nearest road, and the five operators that have most of them."""
    c = src.cameras(spark, d)
    z, sites = cam.camera_zones(c), c.select("id", F.col("id").alias("site"))
    hit = cam.exposure(segments(spark, d), edges(spark, d), z, sites).select(F.col("site").alias("id")).distinct().withColumn("hit", F.lit(True))
    loose = cam.exposure(segments(spark, d), edges(spark, d), cam.camera_zones(c, omni=True), sites).select(F.col("site").alias("id")).distinct().withColumn("loose", F.lit(True))
    roads = cam.samples(segments(spark, d)).select("geom_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    range_m, _, eps_m, _ = geo.PROFILES["default"]
    near = nearest_at_any_distance(c.select("id", "x", "y"), roads, "id", "geom_id", range_m + eps_m)
    kind = F.when(F.col("hit"), "captured").when(F.col("dist") <= range_m + eps_m, "bearing mismatch").otherwise("off network")
    rows = c.select("id", "operator").join(hit, "id", "left").join(loose, "id", "left").join(near, "id", "left").withColumn("kind", F.explode(F.array(kind, F.lit("all"))))
    rows = cut(rows.select("kind", "operator", "dist", "loose"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "operator")
    first = rows.groupBy("kind", "operator").agg(F.count(F.lit(1)).alias("n")).withColumn("i", F.row_number().over(w)).filter("i <= 5")
    named = F.array_sort(F.collect_list(F.struct("i", F.concat(F.col("operator").cast("string"), F.lit(":"), F.col("n").cast("string")).alias("t"))))  # five at most
    top = first.groupBy("kind").agg(F.array_join(F.transform(named, lambda r: r["t"]), ",").alias("operators"))
    sums = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("loose", F.lit(False))).alias("n_any_heading"))
    return sums.join(medians(rows, "kind", "dist", "m").drop("n"), "kind", "left").join(top, "kind").select("kind", "n", "n_any_heading", F.round("m", 4).alias("median_m"), "operators")


def density_cells(spark, d):
    c = src.cameras(spark, d)
    return c.groupBy(F.floor(F.col("x") / 1000).cast("long").alias("cx"), F.floor(F.col("y") / 1000).cast("long").alias("cy")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cx", "cy").limit(8)


def brand_topn(spark, d):
    return src.cameras(spark, d).groupBy("operator").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "operator").limit(5)


def duplicate_cells(spark, d):
    c = src.cameras(spark, d)
    return c.groupBy(F.floor(F.col("x") / 22).cast("long").alias("cx"), F.floor(F.col("y") / 22).cast("long").alias("cy")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def exposed_road_km(spark, d):
    """Length of exposed edges, of all edges, and the share of sites that see one."""
    x, e = _exposure(spark, d), edges(spark, d)
    sums = x.groupBy("edge_id").agg(F.sum("units").alias("u"))
    km = e.join(sums, "edge_id", "left").agg(F.round(F.sum(F.when(F.col("u") > 0, F.col("len"))) / 1000, 4).alias("exposed_km"), F.round(F.sum("len") / 1000, 4).alias("all_km"))
    seen = x.agg(F.count_distinct("site").alias("s"))
    every = cam.capture_sites(src.cameras(spark, d)).agg(F.count_distinct("site").alias("n"))
    return km.join(seen.join(every)).select("exposed_km", "all_km", F.round(F.col("s") / F.col("n"), 6).alias("site_share"))  # one row each


def site_cards(spark, d):
    c = src.cameras(spark, d)
    out = cam.site_cards(cam.camera_zones(c), cam.capture_sites(c))
    return out.select("site", F.col("n").cast("long").alias("n"), "title", "watches")


def camera_sectors(spark, d):
    """Outlines of each camera's first sector for display: the points in order."""
    z = cam.camera_zones(src.cameras(spark, d)).withColumn("s", F.get("sectors", F.lit(0)))
    out = z.select("id", F.posexplode(geo.sector_points("x", "y", F.col("s.bearing"), F.col("s.half_angle"), "range_m")).alias("i", "p"))
    return out.select("id", "i", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


def live_position_zones(spark, d):
    z = cam.camera_zones(src.cameras(spark, d)).select("id", F.col("x").alias("x2"), F.col("y").alias("y2"), "mode", "sectors", "range_m", "eps_m", "tol")
    near = proximity_join(src.fixes(spark, d).select("event_id", "x", "y", "heading"), z, 62.0)
    inside = geo.captures(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"), "heading", "mode", F.col("sectors"), "range_m", "eps_m", "tol")
    return near.filter(inside).select("event_id", "id")


QUERIES = {f.__name__: f for f in (
    camera_direction_parse, direction_quality, camera_zones, zone_reference, sector_distance_grid, capture_predicate, camera_site_pairs, capture_sites, edge_exposure, exposure_after_changes, exposure_totals,
    edge_exposure_rings, near_only_sites, segment_zone_join, orphan_cameras, orphan_report, density_cells, brand_topn, duplicate_cells, exposed_road_km, site_cards, camera_sectors, live_position_zones,
)}

# ---------------------------------------------------------------------------------------------- SQL


def wrap(x: str) -> str:
    return f"(((({x}) + 180) % 360 + 360) % 360 - 180)"


def bearing(dx: str, dy: str) -> str:
    return f"((degrees(atan2({dx}, {dy})) % 360 + 360) % 360)"


def hyp(a: str, b: str) -> str:
    return f"sqrt(({a}) * ({a}) + ({b}) * ({b}))"


def dist(px: str, py: str, b: str, half: str, r: str) -> str:
    d, off = hyp(px, py), f"abs({wrap(f'{bearing(px, py)} - ({b})')})"
    phi = f"radians(least({off} - {half}, 180.0))"
    return f"(CASE WHEN {off} <= {half} THEN greatest({d} - {r}, 0) WHEN {d} * cos({phi}) <= 0 THEN {d} WHEN {d} * cos({phi}) >= {r} THEN sqrt(greatest({d} * {d} + {r} * {r} - 2 * {d} * {r} * cos({phi}), 0)) ELSE {d} * sin({phi}) END)"


def match(h: str, b: str, mode: str, tol: str) -> str:
    off = f"abs({wrap(f'{h} - ({b})')})"
    return f"(CASE {mode} WHEN 'any' THEN true WHEN 'rear' THEN {off} <= {tol} ELSE least({off}, 180 - {off}) <= {tol} END)"


CAMERAS = """
    ext AS (SELECT (max(p_partkey) // 20 + 1) * 200 AS ext FROM part),
    cam0 AS (SELECT c_custkey AS id, CASE WHEN (c_custkey // 3) % 2 = 0 THEN 3 * (c_custkey // 3) ELSE c_custkey END AS b, CASE WHEN (c_custkey // 3) % 2 = 0 THEN (c_custkey % 3) * 20 ELSE 0 END AS shift, * FROM customer),
    cam AS (SELECT id, CAST((b * 37) % 4000 + shift AS DOUBLE) AS x, CAST((b * 91) % ext AS DOUBLE) AS y,
        (['45', '-30', '90;270', '10-30', 'NE', 'ssw', 'forward', NULL, '350-10', '360', '150000099', '180.5'])[id % 12 + 1] AS direction,
        CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Flock Safety' ELSE c_mktsegment END AS brand, c_nationkey AS operator FROM cam0, ext)"""
SECTORS = CAMERAS + r""",
    dp AS (SELECT id, unnest(string_split(upper(direction), ';')) AS p, unnest(range(0, len(string_split(direction, ';')))) AS k FROM cam WHERE direction IS NOT NULL),
    dq AS (SELECT id, k, CASE WHEN regexp_matches(p, '^-?[0-9]+([.][0-9]+)?$') THEN CASE WHEN abs(CAST(p AS DOUBLE)) <= 360 THEN (CAST(p AS DOUBLE) % 360 + 360) % 360 END
            WHEN regexp_matches(p, '^[0-9]+-[0-9]+$') THEN CASE WHEN CAST(split_part(p, '-', 1) AS DOUBLE) <= 360 THEN (CAST(split_part(p, '-', 1) AS DOUBLE) + ((CAST(split_part(p, '-', 2) AS DOUBLE) - CAST(split_part(p, '-', 1) AS DOUBLE)) % 360 + 360) % 360 / 2) % 360 END
            ELSE (map {'N': 0.0, 'NNE': 22.5, 'NE': 45.0, 'ENE': 67.5, 'E': 90.0, 'S': 180.0, 'SSW': 202.5, 'SW': 225.0, 'W': 270.0})[p] END AS bearing,
        CASE WHEN regexp_matches(p, '^[0-9]+-[0-9]+$') THEN ((CAST(split_part(p, '-', 2) AS DOUBLE) - CAST(split_part(p, '-', 1) AS DOUBLE)) % 360 + 360) % 360 / 2 ELSE 0.0 END AS extra FROM dp),
    sect AS (SELECT id, CAST(k AS INTEGER) AS k, CAST(bearing AS DOUBLE) AS bearing, extra FROM dq WHERE id NOT IN (SELECT id FROM dq WHERE bearing IS NULL))"""
EDGES = """
    rn AS (SELECT p_partkey AS n, CAST((p_partkey % 20) * 200 + (p_size % 7) * 5 AS DOUBLE) AS x, CAST((p_partkey // 20) * 200 + (p_size * 3 % 7) * 5 AS DOUBLE) AS y, p_size, p_name AS name FROM part),
    geom AS (SELECT u.n * 2 + g.down AS geom_id, u.n AS u, v.n AS v, u.x AS ax, u.y AS ay, v.x AS bx, v.y AS by_, u.p_size % 13 = 0 AS us, v.p_size % 13 = 0 AS vs, u.p_size % 9 = 0 AS one_way, u.name,
        (['primary', 'secondary', 'residential', 'tertiary'])[u.n % 4 + 1] AS class, CAST(([65, 55, 30, 45])[u.n % 4 + 1] AS DOUBLE) AS kmh, sqrt((v.x - u.x) * (v.x - u.x) + (v.y - u.y) * (v.y - u.y)) AS len
        FROM rn u, (VALUES (0), (1)) g(down), rn v WHERE v.n = u.n + CASE WHEN g.down = 1 THEN 20 ELSE 1 END AND (g.down = 1 OR u.n % 20 < 19)),
    edge AS (SELECT geom_id * 2 + r AS edge_id, geom_id, r = 1 AS rev, CASE WHEN r = 1 THEN v ELSE u END AS src, CASE WHEN r = 1 THEN u ELSE v END AS dst, len, class, kmh, name,
        len / (kmh / 3.6) + CASE WHEN CASE WHEN r = 1 THEN us ELSE vs END THEN 8 ELSE 0 END AS time_s,
        (round(((degrees(CASE WHEN r = 1 THEN atan2(ax - bx, ay - by_) ELSE atan2(bx - ax, by_ - ay) END) % 360 + 360) % 360) * 100) % 36000) / 100 AS heading
        FROM geom, (VALUES (0), (1)) q(r) WHERE (r = 0 OR NOT one_way) AND CASE WHEN r = 1 THEN v ELSE u END % 53 <> 7)"""
SITES = """
    pair AS (SELECT a.id AS a, b.id AS b FROM cam a JOIN cam b ON b.x BETWEEN a.x - 25 AND a.x + 25 AND b.y BETWEEN a.y - 25 AND a.y + 25 AND a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 25),
    reach(a, b) AS (SELECT id, id FROM cam UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a),
    site AS (SELECT a AS id, min(b) AS site FROM reach GROUP BY a)"""
SAMPLES = """
    samp AS (SELECT *, unnest(range(0, n + 1)) AS j FROM (SELECT *, CAST(greatest(1, ceil(len / 5.0)) AS BIGINT) AS n FROM geom WHERE len > 0.01)),
    pt AS (SELECT geom_id, j, len AS L, ax + (j / n) * (bx - ax) AS x, ay + (j / n) * (by_ - ay) AS y, (j / n) * len AS along, CASE WHEN j < n THEN len / n ELSE 0 END AS weight, ((degrees(atan2(bx - ax, by_ - ay)) % 360 + 360) % 360) AS heading FROM samp)"""


def zone_cte(name: str, params: tuple[float, float, float, float], both_ways: bool = False, omni: bool = False) -> str:
    r, half, eps, tol = params
    mode = "'any'" if omni else ("'axis'" if both_ways else "CASE WHEN c.brand LIKE 'Flock%' THEN 'rear' ELSE 'axis' END")
    return f""",
    {name} AS (SELECT c.id, c.x, c.y, CASE WHEN s.id IS NULL THEN 'any' ELSE {mode} END AS mode, coalesce(s.k, 0) AS k, coalesce(s.bearing, 0.0) AS b, CASE WHEN s.id IS NULL THEN 180.0 ELSE least(180.0, {half} + s.extra) END AS half, {r} AS r, {eps} AS eps, {tol} AS tol,
        CASE WHEN first_value(CASE WHEN s.id IS NULL THEN 180.0 ELSE least(180.0, {half} + s.extra) END) OVER (PARTITION BY c.id ORDER BY s.k) >= 180 THEN {2 * (r + eps)} ELSE {r + 2 * eps} END AS ref
        FROM cam c LEFT JOIN sect s USING (id))"""


def exposure_cte(name: str, zone: str, site: str = "site") -> str:
    px, py, h = "(p.x - z.x)", "(p.y - z.y)", "(p.heading + CASE WHEN e.rev THEN 180 ELSE 0 END)"
    return f""",
    {name}_hit AS (SELECT DISTINCT e.edge_id, s.site, p.j, CASE WHEN e.rev THEN e.len - p.along ELSE p.along END AS along, p.weight, e.len
        FROM {zone} z JOIN {site} s ON s.id = z.id JOIN pt p ON p.x BETWEEN z.x - z.r - z.eps AND z.x + z.r + z.eps AND p.y BETWEEN z.y - z.r - z.eps AND z.y + z.r + z.eps JOIN edge e ON e.geom_id = p.geom_id
        WHERE {dist(px, py, "z.b", "z.half", "z.r")} <= z.eps AND {match(h, "z.b", "z.mode", "z.tol")}),
    {name} AS (SELECT edge_id, h.site, min(along) AS entry_m, max(along) AS exit_m, least(1.0, sum(weight) / any_value(q.ref)) AS units, max(along) >= any_value(len) - 0.05 AS at_end
        FROM {name}_hit h JOIN (SELECT s.site, max(ref) AS ref FROM {zone} z JOIN {site} s ON s.id = z.id GROUP BY 1) q ON q.site = h.site GROUP BY edge_id, h.site)"""


DEFAULT, RING = geo.PROFILES["default"], geo.RINGS["default"]
BASE = f"WITH RECURSIVE {SECTORS}, {EDGES}, {SITES}, {SAMPLES}" + zone_cte("zone", DEFAULT)
EXPOSED = BASE + exposure_cte("expo", "zone")
RINGED = EXPOSED + zone_cte("zring", RING, True) + exposure_cte("ring", "zring")



def compass(b: str) -> str:
    return f"(['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'])[CAST(floor({b} / 45 + 0.5) AS INTEGER) % 8 + 1]"


ORACLES = {
    "camera_direction_parse": f"WITH {SECTORS} SELECT c.id, s.k, round(s.bearing, 4) AS bearing, round(s.extra, 4) AS extra FROM cam c LEFT JOIN sect s USING (id)",
    "direction_quality": f"""WITH {CAMERAS} SELECT quality, n, round(n * 100 / sum(n) OVER (), 4) AS pct FROM (SELECT CASE direction WHEN 'forward' THEN 'non-bearing' WHEN '90;270' THEN 'multi' WHEN '10-30' THEN 'multi' WHEN '350-10' THEN 'multi' WHEN '-30' THEN 'out-of-range'
        WHEN '150000099' THEN 'out-of-range' ELSE CASE WHEN direction IS NULL THEN 'missing' ELSE 'ok' END END AS quality, count(*) AS n FROM cam GROUP BY 1)""",
    "camera_zones": BASE + " SELECT id, any_value(mode) AS mode, CAST(count(*) AS INTEGER) AS n_sectors, round(min_by(half, k), 4) AS half_angle, CAST(any_value(r) AS DOUBLE) AS range_m, CAST(any_value(eps) AS DOUBLE) AS eps_m, CAST(any_value(tol) AS DOUBLE) AS tol FROM zone GROUP BY id",
    "zone_reference": f"WITH {SECTORS}" + "".join(zone_cte(k, p) for k, p in [("zs", geo.PROFILES["strict"]), ("zd", DEFAULT), ("zl", geo.PROFILES["loose"])])
    + " SELECT CAST(ref AS DOUBLE) AS ref_m, count(DISTINCT id) AS n, p AS profile FROM (SELECT id, ref, 'strict' AS p FROM zs UNION ALL SELECT id, ref, 'default' FROM zd UNION ALL SELECT id, ref, 'loose' FROM zl) GROUP BY ref, p",
    "sector_distance_grid": f"SELECT id, round({dist('px', 'py', 'b', '30.0', '50.0')}, 6) AS dist FROM (SELECT c_custkey AS id, CAST(c_custkey % 41 * 7 - 140 + 0.5 AS DOUBLE) AS px, CAST(c_custkey % 37 * 9 - 160 + 0.25 AS DOUBLE) AS py, CAST(c_custkey % 24 * 15 + 1 AS DOUBLE) AS b FROM customer)",
    "capture_predicate": "SELECT id, " + ", ".join(f"{dist('px', 'py', 'b', '30.0', '50.0')} <= 12 AND {match('heading', 'b', chr(39) + m + chr(39), '45')} AS by_{m}" for m in ("any", "rear", "axis"))
    + " FROM (SELECT c_custkey AS id, CAST(c_custkey % 41 * 4 - 80 + 0.5 AS DOUBLE) AS px, CAST(c_custkey % 37 * 5 - 90 + 0.25 AS DOUBLE) AS py, CAST(c_custkey % 24 * 15 + 1 AS DOUBLE) AS b, CAST(c_custkey % 72 * 5 + 2 AS DOUBLE) AS heading FROM customer)",
    "camera_site_pairs": BASE + " SELECT a, b FROM pair WHERE a < b",
    "capture_sites": BASE + " SELECT id, site FROM site",
    "edge_exposure": EXPOSED + " SELECT edge_id, site, round(entry_m, 4) AS entry_m, round(exit_m, 4) AS exit_m, round(units, 6) AS units, at_end FROM expo",
    "exposure_after_changes": EXPOSED + " SELECT edge_id, site, round(entry_m, 4) AS entry_m, round(exit_m, 4) AS exit_m, round(units, 6) AS units, at_end FROM expo",
    "exposure_totals": EXPOSED + " SELECT edge_id, count(*) AS sites, round(sum(units), 6) AS units FROM expo GROUP BY edge_id",
    "edge_exposure_rings": RINGED + " SELECT edge_id, layer, count(*) AS sites, round(sum(w), 4) AS weight FROM (SELECT edge_id, 'zone' AS layer, 0.75 AS w FROM expo UNION ALL SELECT edge_id, 'ring', 0.25 FROM ring) GROUP BY edge_id, layer",
    "near_only_sites": RINGED + " SELECT edge_id, site FROM ring r WHERE NOT EXISTS (SELECT 1 FROM expo e WHERE e.edge_id = r.edge_id AND e.site = r.site)",
    "segment_zone_join": BASE + " SELECT c.id, count(*) AS n_samples, count(DISTINCT geom_id) AS n_geoms FROM cam c JOIN pt p ON p.x BETWEEN c.x - 62 AND c.x + 62 AND p.y BETWEEN c.y - 62 AND c.y + 62 WHERE sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) <= 62 GROUP BY c.id",
    "orphan_cameras": BASE.replace("SELECT a AS id, min(b) AS site FROM reach GROUP BY a", "SELECT id, id AS site FROM cam") + zone_cte("zany", DEFAULT, omni=True) + exposure_cte("expo", "zone") + exposure_cte("loose", "zany")
    + " SELECT CASE WHEN id IN (SELECT site FROM expo) THEN 'captured' WHEN id IN (SELECT site FROM loose) THEN 'bearing mismatch' ELSE 'off network' END AS kind, count(*) AS n FROM cam GROUP BY 1",
    "orphan_report": BASE.replace("SELECT a AS id, min(b) AS site FROM reach GROUP BY a", "SELECT id, id AS site FROM cam") + zone_cte("zany", DEFAULT, omni=True) + exposure_cte("expo", "zone") + exposure_cte("loose", "zany")
    + f""", nd AS (SELECT c.id, any_value(c.operator) AS operator, min({hyp("c.x - p.x", "c.y - p.y")}) AS d FROM cam c, pt p GROUP BY c.id),
        kd AS (SELECT *, CASE WHEN id IN (SELECT site FROM expo) THEN 'captured' WHEN d <= 62 THEN 'bearing mismatch' ELSE 'off network' END AS kind FROM nd UNION ALL SELECT *, 'all' FROM nd),
        tp AS (SELECT kind, string_agg(operator || ':' || n, ',' ORDER BY n DESC, operator) AS operators FROM (SELECT kind, operator, count(*) AS n FROM kd GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, operator) <= 5) GROUP BY 1)
        SELECT kind, count(*) AS n, count(*) FILTER (id IN (SELECT site FROM loose)) AS n_any_heading, round(median(d), 4) AS median_m, any_value(operators) AS operators FROM kd JOIN tp USING (kind) GROUP BY kind""",
    "density_cells": f"WITH {CAMERAS} SELECT CAST(floor(x / 1000) AS BIGINT) AS cx, CAST(floor(y / 1000) AS BIGINT) AS cy, count(*) AS n FROM cam GROUP BY 1, 2 ORDER BY n DESC, cx, cy LIMIT 8",
    "brand_topn": f"WITH {CAMERAS} SELECT operator, count(*) AS n FROM cam GROUP BY 1 ORDER BY n DESC, operator LIMIT 5",
    "duplicate_cells": f"WITH {CAMERAS} SELECT CAST(floor(x / 22) AS BIGINT) AS cx, CAST(floor(y / 22) AS BIGINT) AS cy, count(*) AS n FROM cam GROUP BY 1, 2 HAVING count(*) > 1",
    "camera_sectors": BASE
    + """, f AS (SELECT id, any_value(x) AS x, any_value(y) AS y, min_by(b, k) AS b, min_by(half, k) AS h, any_value(r) AS r FROM zone GROUP BY id), g AS (SELECT *, unnest(range(0, 10)) AS i FROM f)
        SELECT id, CAST(i AS INTEGER) AS i, round(CASE WHEN i = 0 THEN x ELSE x + r * sin(radians(b - h + h * (i - 1) / 4)) END, 4) AS x, round(CASE WHEN i = 0 THEN y ELSE y + r * cos(radians(b - h + h * (i - 1) / 4)) END, 4) AS y FROM g""",
    "site_cards": BASE
    + f""", br AS (SELECT id, site, CASE WHEN brand LIKE '% %' THEN brand ELSE brand[1] || lower(brand[2:]) END AS brand FROM cam JOIN site USING (id)), bt AS (SELECT site, string_agg(brand, ', ' ORDER BY f) AS t FROM (SELECT site, brand, min(id) AS f FROM br GROUP BY 1, 2) GROUP BY site),
        wt AS (SELECT id, any_value(mode) AS mode, string_agg({compass('b')}, ' & ' ORDER BY k) AS one, string_agg({compass('b')} || '–' || {compass('(b + 180) % 360')}, ' & ' ORDER BY k) AS two FROM zone GROUP BY id), n AS (SELECT site, count(*) AS n, min(id) AS first FROM br GROUP BY site)
        SELECT n.site, n, t || CASE WHEN n > 1 THEN ' · ' || n || ' cameras' ELSE '' END AS title, CASE mode WHEN 'any' THEN 'direction unknown' WHEN 'rear' THEN 'reads plates heading ' || one ELSE 'reads plates along ' || two END AS watches FROM n JOIN bt USING (site) JOIN wt ON wt.id = n.first""",
    "exposed_road_km": EXPOSED + " SELECT round(sum(len) FILTER (u > 0) / 1000, 4) AS exposed_km, round(sum(len) / 1000, 4) AS all_km, (SELECT round(count(DISTINCT site) / (SELECT count(DISTINCT site) FROM site), 6) FROM expo) AS site_share FROM edge LEFT JOIN (SELECT edge_id, sum(units) AS u FROM expo GROUP BY 1) USING (edge_id)",
    "live_position_zones": BASE + f""", fx AS (SELECT event_id, CAST((event_id * 53) % 4000 AS DOUBLE) AS x, CAST((event_id * 31) % 4000 AS DOUBLE) AS y, CAST((coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) * 37) % 360 AS DOUBLE) AS heading FROM events)
        SELECT DISTINCT f.event_id, z.id FROM zone z JOIN fx f ON f.x BETWEEN z.x - 62 AND z.x + 62 AND f.y BETWEEN z.y - 62 AND z.y + 62 WHERE {dist('(f.x - z.x)', '(f.y - z.y)', 'z.b', 'z.half', 'z.r')} <= z.eps AND {match('f.heading', 'z.b', 'z.mode', 'z.tol')}""",
}
