"""Exposure that follows a camera feed: each batch of changes recomputes the sites it touches and carries the rest over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.functions import geo
from wayglass.operators import cameras as cam
from wayglass.operators.proximity import cell, proximity_join, with_cells
from wayglass.operators.release import newest
from wayglass.plans.iterate import cut
from wayglass.streaming.feeds import Refused, Snapshots, gate

CAMERAS = "id long, x double, y double, direction string, brand string, version long, site long, bucket int"
EXPOSED = "edge_id long, site long, entry_m double, exit_m double, units double, at_end boolean, bucket int"
BLOCK_M = 4096.0


def near_segments(segments: DataFrame, cameras: DataFrame, reach: float) -> DataFrame:
    """The segments that can have a sample within reach of a camera (x, y), and maybe some more. Segments are looked at every `reach` metres, so that long ones meet few cells."""
    coarse = with_cells(cam.samples(segments, reach), "x", "y", 2 * reach).select("geom_id", "k", "cx", "cy").distinct()
    cells = with_cells(cameras.select("x", "y"), "x", "y", 2 * reach, 1).select("cx", "cy").distinct()
    return segments.join(coarse.join(cells, ["cx", "cy"], "left_semi").select("geom_id", "k").distinct(), ["geom_id", "k"], "left_semi")


class ExposureView:
    """Tables in a folder: cameras/version=<n>, exposure/version=<n>/bucket=<b>, and state/snapshot=<n>, which says for each bucket the version that holds its rows.

    A row of exposure belongs to a site, and a site to the bucket of the block in which its smallest camera stands. A batch touches the sites of the cameras that it changes and the
    sites within the site radius of where they are now; sites form anew among the cameras of these alone, since no other camera is linked with one of them. Only roads within reach of
    these cameras are sampled and only buckets of these sites are read and written; the others keep the version they have.

    The state is written last, in one write: readers see a version whole or not at all, a batch that failed on the way is simply done again, and one that is there already is skipped.
    There are at most `buckets` buckets, so the state is small and its rows may be collected. Changes: id, x, y, direction, brand, version, deleted; older versions than those that are
    there change nothing, nor do changes without an id. Cameras without a position are kept and see nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, segments: DataFrame, edges: DataFrame, params: tuple[float, float, float, float] = geo.PROFILES["default"], buckets: int = 1024):
        self.spark, self.folder, self.segments, self.edges, self.params, self.buckets = spark, folder.rstrip("/"), segments, edges, params, buckets
        self.state = Snapshots(spark, f"{self.folder}/state")

    def versions(self) -> dict[int, int]:
        """The version of each bucket's rows; under -1 that of the cameras, which is the view's position."""
        now = self.state.current()
        return {} if now is None else {r["bucket"]: r["version"] for r in now.collect()}

    def _rows(self, versions: dict[int, int], only: set[int] | None = None) -> DataFrame:
        paths = {v: f"{self.folder}/exposure/version={v}" for b, v in versions.items() if b >= 0 and (only is None or b in only)}
        out = self.spark.createDataFrame([], EXPOSED)
        for v, path in sorted(paths.items()):
            mine = sorted(b for b, w in versions.items() if w == v and b >= 0 and (only is None or b in only))
            out = out.unionByName(self.spark.read.schema(EXPOSED).parquet(path).filter(F.col("bucket").isin(mine)))
        return out

    def exposure(self) -> DataFrame:
        return self._rows(self.versions()).drop("bucket")

    def cameras(self) -> DataFrame | None:
        at = self.versions().get(-1)
        return None if at is None else self.spark.read.schema(CAMERAS).parquet(f"{self.folder}/cameras/version={at}")

    def _bucket(self) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(cell(F.col("x"), BLOCK_M), cell(F.col("y"), BLOCK_M)), F.lit(self.buckets)), F.lit(0)).cast("int")

    def _merged(self, before: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cameras with was: the site that they belonged to; the sites that the changes touch)."""
        names = ["id", "x", "y", "direction", "brand", "version"]
        fresh = newest(changes.filter("id is not null"), ["id"], [F.col("version"), F.coalesce("deleted", F.lit(False))])
        fresh = cut(fresh.join(before.select("id", F.col("version").alias("_v"), F.col("site").alias("was"), F.lit(True).alias("_known")), "id", "left").filter("_v is null or version > _v"))
        here = fresh.filter(~F.coalesce(F.col("deleted"), F.lit(False)))
        close = proximity_join(here.select("x", "y"), before.select("site", F.col("x").alias("x2"), F.col("y").alias("y2")), geo.SITE_RADIUS_M)
        touched = cut(fresh.filter("was is not null").select(F.col("was").alias("site")).union(close.select("site")).distinct())
        stay = before.join(fresh.select("id"), "id", "left_anti").select(*names, F.col("site").alias("was"), "bucket")
        return stay.unionByName(here.select(*names, F.lit(None).cast("long").alias("was"), F.lit(None).cast("int").alias("bucket"))), touched

    def apply(self, changes: DataFrame, number: int, force: bool = False) -> bool:
        """Whether the batch was applied: False if it was there already. A feed that has shrunk too far is refused with an error, unless forced; the view stays as it is."""
        versions = self.versions()
        if versions.get(-1, -1) >= number:
            return False
        before = self.cameras()
        known = self.spark.createDataFrame([], CAMERAS) if before is None else before
        now, touched = self._merged(known, changes)
        now = cut(now)
        verdict = gate(now, before)
        if verdict != "ok" and not (force and verdict == "shrunk"):
            raise Refused(verdict, number)
        rest = now.join(touched, F.col("was") == F.col("site"), "left_anti").filter("was is not null")
        moved = cut(now.join(rest.select("id"), "id", "left_anti").drop("was", "bucket"))
        placed = moved.filter("x is not null and y is not null")
        sites = cut(cam.capture_sites(placed).unionByName(moved.filter("x is null or y is null").select("id", F.col("id").alias("site"))))
        anchors = moved.select(F.col("id").alias("site"), self._bucket().alias("bucket"))
        fresh = moved.join(sites.join(anchors, "site"), "id")
        rest.withColumnRenamed("was", "site").unionByName(fresh).select(*[c.split()[0] for c in CAMERAS.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/cameras/version={number}")
        old = known.join(touched, "site", "left_semi").select("bucket")
        hit = {r["bucket"] for r in old.union(fresh.select("bucket")).distinct().collect()}  # at most self.buckets numbers
        range_m, _, eps_m, _ = self.params
        zones = cam.camera_zones(placed, self.params)
        rows = cam.exposure(near_segments(self.segments, placed, range_m + eps_m), self.edges, zones, sites).join(fresh.select("site", "bucket").distinct(), "site")
        carried = self._rows(versions, hit).join(touched, "site", "left_anti")
        target = f"{self.folder}/exposure/version={number}"
        carried.unionByName(rows.select(carried.columns)).write.mode("overwrite").partitionBy("bucket").parquet(target)
        full = {r["bucket"] for r in self.spark.read.schema(EXPOSED).parquet(target).select("bucket").distinct().collect()}
        state = {b: v for b, v in versions.items() if b not in hit} | dict.fromkeys(full, number) | {-1: number}
        self.state.publish(self.spark.createDataFrame(sorted(state.items()), "bucket int, version long").coalesce(1), number, force=True)
        return True


def follow_cameras(stream: DataFrame, view: ExposureView, checkpoint: str, force: bool = False):
    """A query that applies each micro-batch of changes. A batch that comes again after a failure is skipped if it is there, and a refused one fails the query."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: view.apply(cut(batch), number, force) and None).start()
