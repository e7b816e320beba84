"""The jobs of a release as tables: regions and their checks, batches, staged names, manifests, retention, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may be pruned, what never is, the schema of a manifest, the share below which a feed is refused.
PRUNABLE, NEVER = ("packs/", "basemap/", "places/"), ("basemap/assets/",)
MANIFEST_SCHEMA = 2
LEAST_SHARE = 0.5


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def hashed_path(folder: str, region: Column, content: Column, suffix: str) -> Column:
    """<folder>/<region>.<first ten digits of the content's hash><suffix>: another content never has an older one's name."""
    return F.concat(F.lit(f"{folder}/"), region, F.lit("."), F.substring(F.sha2(content.cast("binary"), 256), 1, 10), F.lit(suffix))


def gate_of(n: Column, before: Column) -> Column:
    """ok, empty, or shrunk against the feed before (null: there was none)."""
    return F.when(n == 0, "empty").when(n < LEAST_SHARE * before, "shrunk").otherwise("ok")


def feed_gates(fresh: DataFrame, before: DataFrame, by: str) -> DataFrame:
    """by, n, was, gate of each feed that is there or was."""
    count = lambda df, name: df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    both = count(fresh, "n").join(count(before, "was"), by, "full_outer").fillna(0, ["n"])
    return both.select(by, "n", "was", gate_of(F.col("n"), F.col("was")).alias("gate"))


def region_problems(regions: DataFrame) -> DataFrame:
    """place, id, problems (empty: none) of regions (place, id, west, south, east, north, sources)."""
    twice = regions.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("twice"))
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    rules = (
        ("duplicate id", F.col("twice")), ("bad box", ~((w >= -180) & (w < e) & (e <= 180) & (s >= -90) & (s < n) & (n <= 90))),
        ("bad sources", (F.size("sources") < 1) | (F.size(F.array_distinct("sources")) < F.size("sources"))), ("bad id", ~F.col("id").rlike("^[a-z0-9-]*[a-z0-9][a-z0-9-]*$")),
    )
    return regions.join(twice, "id").select("place", "id", F.array_compact(F.array(*[F.when(c, name) for name, c in rules])).alias("problems"))


def batch_plan(regions: DataFrame) -> DataFrame:
    """batch, n, regions, sources (each once, in the order of the regions), biggest batch first. regions: batch, place, id, sources."""
    rows = F.array_sort(F.collect_list(F.struct("place", "id", "sources")))  # a configuration: as many rows as there are regions of one batch
    plan = regions.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), rows.alias("rows"))
    return plan.select("batch", "n", F.col("rows.id").alias("regions"), F.array_distinct(F.flatten("rows.sources")).alias("sources")).orderBy(F.desc("n"), "batch")


def region_states(regions: DataFrame, states: DataFrame) -> DataFrame:
    """id, states (names in the order of the sources), home (name, or the extract's own), batch. regions: id, sources; states: source, name, batch."""
    at = regions.select("id", F.posexplode("sources").alias("k", "source")).join(states, "source", "left")
    own = F.initcap(F.replace(F.element_at(F.split("source", "/"), -1), F.lit("-"), F.lit(" ")))
    rows = at.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "name", F.coalesce("name", own).alias("shown"), "batch"))).alias("s"))
    named = F.transform(F.filter("s", lambda x: x["name"].isNotNull()), lambda x: x["name"])
    return rows.select("id", named.alias("states"), F.col("s")[0]["shown"].alias("home"), F.coalesce(F.col("s")[0]["batch"], F.lit("other")).alias("batch"))


def stalest(regions: DataFrame, sources: DataFrame) -> DataFrame:
    """id, as_of: a region is as current as its stalest source that has a time. sources: source, stamp."""
    at = regions.select("id", F.explode("sources").alias("source")).join(sources, "source", "left")
    return at.groupBy("id").agg(F.min("stamp").alias("as_of"))


def newest_build(keys: DataFrame, suffix: str = ".pmtiles") -> DataFrame:
    """build: the newest key of eight digits and a suffix; null if there is none."""
    valid = F.regexp_extract("key", "^([0-9]{8})" + suffix.replace(".", r"\.") + "$", 1)
    return keys.agg(F.max(F.nullif(valid, F.lit(""))).alias("build"))


def stale_keys(listing: DataFrame, kept: DataFrame, now: Column, hours: float) -> DataFrame:
    """key of what may go: of a prunable kind, not a folder, not kept, known to be old enough. listing: key, modified; kept: key."""
    starts = lambda prefixes: F.array_contains(F.transform(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("key"), p)), True)
    old = F.unix_micros(now) - F.unix_micros(F.col("modified").cast("timestamp")) >= hours * 3.6e9
    return listing.filter(starts(PRUNABLE) & ~starts(NEVER) & ~F.endswith("key", F.lit("/")) & old).join(kept, "key", "left_anti").select("key")


def kept_paths(manifest: DataFrame, previous: DataFrame | None, generated: Column, now: Column, hours: float) -> DataFrame:
    """key: what a manifest names; for a while after the switch also what the one before named. Both: path."""
    own = manifest.select(F.col("path").alias("key"))
    if previous is None:
        return own.distinct()
    recent = F.unix_micros(now) - F.unix_micros(generated) < hours * 3.6e9
    return own.unionByName(previous.filter(recent).select(F.col("path").alias("key"))).distinct()


def assembled(config: DataFrame, fresh: DataFrame, live: DataFrame, feeds: DataFrame, live_schema: int = MANIFEST_SCHEMA, basemap: str | None = None) -> DataFrame:
    """Entries of the new manifest in the order of the configuration.

    config: id, place; fresh, live: id, version, basemap; feeds: id. Fresh entries win over live ones, which count only if their manifest has
    the schema that is understood. Regions that aren't configured, have no feed, or neither a basemap nor one of the country, are left out.
    """
    old = live.select("id", F.col("version").alias("v"), F.col("basemap").alias("b")) if live_schema == MANIFEST_SCHEMA else live.limit(0).select("id", F.col("version").alias("v"), F.col("basemap").alias("b"))
    both = fresh.withColumn("is_fresh", F.lit(True)).join(old, "id", "full_outer")
    won = F.coalesce("is_fresh", F.lit(False))
    pick = lambda a, b: F.when(won, F.col(a)).otherwise(F.col(b))
    entries = both.select("id", pick("version", "v").alias("version"), (F.lit(basemap) if basemap else pick("basemap", "b")).alias("basemap"), F.when(won, "fresh").otherwise("live").alias("origin"))
    return entries.join(config, "id").join(feeds.select("id").distinct(), "id", "left_semi").filter("basemap is not null").orderBy("place")


def reused(parts: DataFrame, live: DataFrame) -> DataFrame:
    """id, kind, path, reused: a part whose fingerprint is the live one's keeps the live file's name. parts: id, kind, fingerprint, path."""
    old = live.select("id", "kind", F.col("fingerprint").alias("f"), F.col("path").alias("p"))
    same = F.coalesce(F.col("f") == F.col("fingerprint"), F.lit(False))
    return parts.join(old, ["id", "kind"], "left").select("id", "kind", F.when(same, F.col("p")).otherwise(F.col("path")).alias("path"), same.alias("reused"))


def outcomes(rows: DataFrame) -> DataFrame:
    """status, n, bytes (each path once), heaviest (region with the largest file, the first name among equals). rows: region, status, path, bytes."""
    tally = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max_by("region", F.struct("bytes", (-F.col("order")).alias("o"))).alias("heaviest"))
    once = rows.groupBy("status", "path").agg(F.max("bytes").alias("bytes")).groupBy("status").agg(F.sum("bytes").alias("bytes"))
    return tally.join(once, "status")


def retained(cached: DataFrame, most: int = 4) -> DataFrame:
    """area, version of what a cache keeps: of each area its newest version, of the areas the `most` that were used last. cached: area, version, seen."""
    newest = cached.groupBy("area").agg(F.max("version").alias("version"), F.max("seen").alias("seen"))
    return newest.orderBy(F.desc("seen"), "area").limit(most).select("area", "version")


def latest_answers(requests: DataFrame, session: str, sequence: str, failed: Column) -> DataFrame:
    """session, answered: the newest request that was answered; older answers that come later are stale."""
    return requests.filter(~failed).groupBy(F.col(session).alias("session")).agg(F.max(sequence).alias("answered"))


def in_us(lat: Column, lon: Column) -> Column:
    """Within the boxes of the lower 48 states, Alaska or Hawaii."""
    boxes = ((24, 50, -125, -66), (51, 72, -180, -129), (18, 23, -161, -154))
    found = F.lit(False)
    for south, north, west, east in boxes:
        found = found | (lat.between(south, north) & lon.between(west, east))
    return found


def split_by_box(points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """side, n, first (smallest id) of points (id, x, y) within and outside a box (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = box
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    return points.groupBy(F.when(inside, "inside").otherwise("outside").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def row_major(points: DataFrame, height: float = 1000.0) -> DataFrame:
    """id, row, i: place of each point within its row of the plane, from west to east."""
    row = F.floor(F.col("y") / height)
    return points.withColumn("row", row).withColumn("i", F.row_number().over(Window.partitionBy("row").orderBy("x", "y", "id"))).select("id", "row", "i")


def route_rows(routes: DataFrame) -> DataFrame:
    """What is handed out of a route: renamed and in the units of the screen. routes: id, time_s, length_m, sites (array)."""
    return routes.select("id", (F.col("time_s") / 60).alias("minutes"), (F.col("length_m") / 1000).alias("km"), F.size("sites").alias("n_sites"), F.get("sites", F.lit(0)).alias("first_site"))


def keys_without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: how many more rows left has of each key than right, where it has more. Counted before the shuffle, so hot keys are cheap."""
    sign = left.select(*keys, F.lit(1).alias("_sign")).unionByName(right.select(*keys, F.lit(-1).alias("_sign")))
    return sign.groupBy(*keys).agg(F.sum("_sign").alias("n")).filter("n > 0")
