"""Feeds and listings: camera tiles, object listings, boundary polygons, verified files, manifests."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.operators.release import newest

CAMERA = "id long, lat double, lon double, tags map<string,string>"
#: Fixed value: degrees of a tile.
TILE_DEGREES = 20


def tile_origins(west: float, south: float, east: float, north: float) -> list[tuple[int, int]]:
    """South-west corners (lat, lon) of the tiles that a box meets."""
    span = lambda a, b: range(int(a // TILE_DEGREES) * TILE_DEGREES, int(b // TILE_DEGREES) * TILE_DEGREES + 1, TILE_DEGREES)
    return [(lat, lon) for lat in span(south, north) for lon in span(west, east)]


def cameras(spark: SparkSession, paths: list[str], box: tuple[float, float, float, float], margin: float = 0.003) -> DataFrame:
    """Cameras of JSON tiles within a box and a margin; of several records of one id the last tile's counts."""
    df = spark.read.schema(CAMERA).option("multiLine", True).json(paths).withColumn("tile", F.input_file_name())
    west, south, east, north = box
    inside = F.col("lon").between(west - margin, east + margin) & F.col("lat").between(south - margin, north + margin)
    return newest(df.filter(inside & F.col("id").isNotNull()), ["id"], [F.col("tile")]).drop("tile")


def listed(lines: DataFrame) -> DataFrame:
    """lines (value, and others) as key, modified: `key<blank>time`; a missing or bad time is null, lines that say None are dropped."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return lines.withColumns({"key": F.get(parts, F.lit(0)), "modified": F.get(parts, F.lit(1)).try_cast("timestamp")}).filter("key not in ('None', '')").drop("value")


def listing(spark: SparkSession, path: str) -> DataFrame:
    return listed(spark.read.text(path))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """file, ring, hole, points of .poly files: rings end with END, those whose name starts with ! are holes."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    rings = F.posexplode(F.regexp_extract_all("value", F.lit(r"(?m)^(\S+)\s*\n((?:\s+-?[0-9.Ee+-]+\s+-?[0-9.Ee+-]+\s*\n)+)END"), F.lit(0))).alias("ring", "body")
    lines = F.filter(F.split("body", r"\n"), lambda x: x.rlike(r"^\s+-?[0-9]"))
    point = lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.cast("double"))
    return whole.select("file", rings).select("file", "ring", F.startswith("body", F.lit("!")).alias("hole"), F.transform(lines, point).alias("points"))


def verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A binary file, if its hash is the one that is expected; an error otherwise."""
    df = spark.read.format("binaryFile").load(path)
    ok = F.sha2("content", 256) == sha256
    return df.withColumn("checked", F.assert_true(ok, F.lit("hash differs"))).drop("checked")


def inflated(files: DataFrame) -> DataFrame:
    """Binary files (path, content) with their content unpacked where its first bytes say gzip."""

    @F.pandas_udf("binary")
    def unpack(content: pd.Series) -> pd.Series:
        return content.map(lambda c: gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c)

    return files.withColumn("content", unpack("content"))


def _little(column: str, at: int, size: int) -> Column:
    """A signed little-endian number at a place of a binary column."""
    digits = F.hex(F.substring(column, at + 1, size))
    raw = F.conv(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]), 16, 10).cast("long")
    return F.when(raw >= 1 << (8 * size - 1), raw - (1 << (8 * size))).otherwise(raw)


def basemaps(spark: SparkSession, path: str) -> DataFrame:
    """path, west, south, east, north (degrees), min_zoom, max_zoom from the fixed headers of tile archives; other files are an error."""
    df = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 127).alias("head"))
    magic = F.substring("head", 1, 8)
    df = df.withColumn("ok", F.assert_true(magic == F.lit(b"PMTiles\x03"), F.lit("not a tile archive of version 3")))
    # fixed places of the format: zooms at 100 and 101, bounds in 1e-7 degrees from 102
    degrees = [(_little("head", 102 + 4 * k, 4) / 1e7).alias(name) for k, name in enumerate(("west", "south", "east", "north"))]
    return df.filter("ok is null").select("path", *degrees, _little("head", 100, 1).alias("min_zoom"), _little("head", 101, 1).alias("max_zoom"))


def manifest(spark: SparkSession, path: str, schema: int = 2) -> DataFrame:
    """Rows of a manifest's regions; refused unless its schema number is the one that is understood."""
    df = spark.read.option("multiLine", True).json(path)
    return df.withColumn("checked", F.assert_true(F.col("schema") == schema, F.lit("unknown manifest schema"))).drop("checked").select(F.explode("regions").alias("r")).select("r.*")
