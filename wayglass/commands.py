"""Jobs from the command line: python -m wayglass <job> ... Each reads and writes tables (Parquet, JSON or listings) through Spark."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.operators import jobs, places
from wayglass.operators.release import newest, report
from wayglass.sources import feeds
from wayglass.streaming.feeds import Snapshots

REGION = "id string, name string, batch string, west double, south double, east double, north double, sources array<string>"
ENTRY = "id string, version long, basemap string"


def regions_of(spark: SparkSession, path: str) -> DataFrame:
    """The configuration in its order; refused if any region has a problem."""
    rows = spark.read.schema(f"regions array<struct<{REGION}>>").option("multiLine", True).json(path).select(F.posexplode("regions").alias("place", "r")).select("place", "r.*")
    bad = jobs.region_problems(rows).filter("size(problems) > 0").collect()  # of a configuration
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {', '.join(r['problems'])}" for r in bad))
    return rows


def plan(spark: SparkSession, config: str, only: str | None = None) -> DataFrame:
    rows = regions_of(spark, config)
    if only:
        rows = rows.filter(F.col("id") == only)
        if rows.isEmpty():
            raise KeyError(only)
    return jobs.batch_plan(rows)


def refresh_cameras(spark: SparkSession, tiles: list[str], box: tuple[float, float, float, float], folder: str, number: int) -> str:
    """Publish the cameras of a box as the feed's next version, unless it is empty or has shrunk by half."""
    return Snapshots(spark, folder).publish(feeds.cameras(spark, tiles, box), number)


def write_part(entries: DataFrame, release: str, name: str) -> None:
    """Entries of one batch of a build."""
    entries.coalesce(1).write.mode("overwrite").json(f"{release}/parts/{name}")


def assemble(spark: SparkSession, config: str, release: str, live: str | None, cameras: list[str], basemap: str | None = None) -> DataFrame:
    """Entries of the new manifest, which is written beside the parts. cameras: regions that have a feed."""
    fresh = spark.read.schema(ENTRY).json(f"{release}/parts/*")
    old = feeds.manifest(spark, live, jobs.MANIFEST_SCHEMA).select("id", "version", "basemap") if live else spark.createDataFrame([], ENTRY)
    has_feed = spark.createDataFrame([(c,) for c in cameras], "id string")
    out = jobs.assembled(regions_of(spark, config), fresh, old, has_feed, basemap=basemap).select("place", "id", "version", "basemap", "origin")
    if out.isEmpty():
        raise RuntimeError("nothing to release: no region has an entry, a basemap and a camera feed")
    whole = out.agg(F.array_sort(F.collect_list(F.struct("place", "id", "version", "basemap"))).alias("regions")).select(F.lit(jobs.MANIFEST_SCHEMA).alias("schema"), "regions")  # a configuration
    whole.coalesce(1).write.mode("overwrite").json(f"{release}/manifest")
    return out


def same_manifest(a: DataFrame, b: DataFrame) -> bool:
    """Whether two manifests list the same entries."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def prune(spark: SparkSession, listing: str, kept: DataFrame, hours: float, now: str | None = None) -> DataFrame:
    return jobs.stale_keys(feeds.listing(spark, listing), kept, F.to_timestamp(F.lit(now)) if now else F.current_timestamp(), hours).orderBy("key")


def merge(objects: list[DataFrame]) -> DataFrame:
    """Objects of neighbouring extracts, each once: the newest version."""
    every = objects[0]
    for df in objects[1:]:
        every = every.unionByName(df)
    return newest(every, ["id"], [F.col("version")])


def place_index(streets: DataFrame, addresses: DataFrame, folder: str) -> DataFrame:
    """Write the index of streets and house numbers: addresses matched to streets, thinned, in the order of streets and numbers. streets: street_id, name, town, x, y, major; addresses: addr_id, street, number, x, y."""
    pieces = places.street_pieces(streets)
    found = places.match_addresses(addresses, streets).join(pieces, "street_id").select("addr_id", F.col("piece").alias("street_id"), "level")
    rows = addresses.join(found, "addr_id")
    kept = places.dedupe_addresses(rows.select("street_id", "number", "addr_id", "x", "y"))
    index = rows.join(kept.select("addr_id"), "addr_id", "left_semi").withColumn("lead", places.tx.house_lead(F.col("number"))).select("street_id", "lead", "number", "addr_id", "x", "y", "level")
    index.repartitionByRange("street_id").sortWithinPartitions("street_id", "lead", "number").write.mode("overwrite").parquet(f"{folder}/addresses")
    streets.join(pieces, "street_id").filter("street_id = piece").drop("piece").write.mode("overwrite").parquet(f"{folder}/streets")
    return index


def main(argv: list[str]) -> int:
    ap = argparse.ArgumentParser(prog="wayglass", description=__doc__)
    todo = ap.add_subparsers(dest="job", required=True)
    p = todo.add_parser("plan")
    p.add_argument("config")
    p.add_argument("--only")
    p = todo.add_parser("check-regions")
    p.add_argument("config")
    p = todo.add_parser("refresh-cameras")
    p.add_argument("folder")
    p.add_argument("number", type=int)
    p.add_argument("tiles", nargs="+")
    p.add_argument("--box", type=float, nargs=4, required=True)
    p = todo.add_parser("assemble")
    p.add_argument("config")
    p.add_argument("release")
    p.add_argument("--live")
    p.add_argument("--basemap")
    p.add_argument("--cameras", nargs="*", default=[])
    p = todo.add_parser("prune")
    p.add_argument("listing")
    p.add_argument("kept", help="a table with the keys that a manifest names")
    p.add_argument("--hours", type=float, default=24.0)
    p = todo.add_parser("report")
    p.add_argument("outcomes")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.job == "plan":
        plan(spark, a.config, a.only).show(1000, False)
    elif a.job == "check-regions":
        print(regions_of(spark, a.config).count(), "regions")
    elif a.job == "refresh-cameras":
        verdict = refresh_cameras(spark, a.tiles, tuple(a.box), a.folder, a.number)
        print(verdict)
        return int(verdict != "ok")
    elif a.job == "assemble":
        assemble(spark, a.config, a.release, a.live, a.cameras, a.basemap).show(1000, False)
    elif a.job == "prune":
        prune(spark, a.listing, spark.read.parquet(a.kept).select("key"), a.hours).show(10_000, False)
    else:
        print(report(spark.read.parquet(a.outcomes)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
