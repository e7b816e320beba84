"""Map objects from OpenStreetMap XML, as three tables. Filters on tags are column predicates after the scan; store as Parquet to push them down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = "tag array<struct<_k:string,_v:string>>"
_NODE = f"_id long, _version int, _lat double, _lon double, {_TAG}"
_WAY = f"_id long, _version int, nd array<struct<_ref:long>>, {_TAG}"
_RELATION = f"_id long, _version int, member array<struct<_type:string,_ref:long,_role:string>>, {_TAG}"


def _read(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    tags = F.coalesce(F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"]))), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return df.withColumn("tags", tags).withColumnsRenamed({"_id": "id", "_version": "version"}).drop("tag")


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """id, version, lat, lon, tags."""
    return _read(spark, path, "node", _NODE).withColumnsRenamed({"_lat": "lat", "_lon": "lon"})


def ways(spark: SparkSession, path: str) -> DataFrame:
    """id, version, refs, tags."""
    return _read(spark, path, "way", _WAY).withColumn("refs", F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.array().cast("array<long>"))).drop("nd")


def relations(spark: SparkSession, path: str) -> DataFrame:
    """id, version, members of (type, ref, role), tags."""
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    return _read(spark, path, "relation", _RELATION).withColumn("members", members).drop("member")


def way_refs(ways_: DataFrame) -> DataFrame:
    """way_id, k, node."""
    return ways_.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("k", "node"))


def restrictions(relations_: DataFrame) -> DataFrame:
    """rid, kind, from_way, via, to_way of turn restrictions by way of a node."""
    r = relations_.filter(F.element_at("tags", "type") == "restriction").select("id", F.element_at("tags", "restriction").alias("kind"), "members").filter("kind is not null")
    first = lambda role, kind: F.get(F.filter("members", lambda m: (m["role"] == role) & (m["type"] == kind)), F.lit(0))["ref"]
    return r.select(F.col("id").alias("rid"), "kind", first("from", "way").alias("from_way"), first("via", "node").alias("via"), first("to", "way").alias("to_way")).dropna()
