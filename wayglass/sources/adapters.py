"""Domain tables derived from the driver's star schema by integer arithmetic: a lattice of roads, cameras, towns, fixes, trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a camera's direction tag says, by customer number modulo 12.
DIRECTIONS = ("45", "-30", "90;270", "10-30", "NE", "ssw", "forward", None, "350-10", "360", "150000099", "180.5")
#: km/h by part number modulo 4.
SPEEDS = {"primary": 65, "residential": 30, "secondary": 55, "tertiary": 45}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, x, y (metres), is_sink, has_signal, one_way."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as node_id", "cast((p_partkey % 20) * 200 + (p_size % 7) * 5 as double) as x", "cast((p_partkey div 20) * 200 + (p_size * 3 % 7) * 5 as double) as y",
        "p_partkey % 53 = 7 as is_sink", "p_size % 13 = 0 as has_signal", "p_size % 9 = 0 as one_way", "p_name as name", "p_partkey % 20 as at_col", "p_partkey div 20 as at_row",
    )


def road_geoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geom_id, u, v, ends' positions, class, kmh, name: lattice neighbours to the right and below."""
    n = road_nodes(spark, sf_dir)
    v = n.select(F.col("node_id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("has_signal").alias("v_signal"))
    u = n.select(F.col("node_id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("has_signal").alias("u_signal"), "one_way", "name", "at_col")
    ends = u.withColumn("down", F.explode(F.array(F.lit(0), F.lit(1)))).filter("down = 1 or at_col < 19").withColumn("v", F.col("u") + F.when(F.col("down") == 1, 20).otherwise(1))
    kinds = F.array(*[F.lit(k) for k in ("primary", "secondary", "residential", "tertiary")])
    speeds = F.array(*[F.lit(float(SPEEDS[k])) for k in ("primary", "secondary", "residential", "tertiary")])
    place = (F.col("u") % 4).cast("int")
    # the estimate of a small file says little about its rows: nodes are never broadcast
    return ends.join(v.hint("merge"), "v").select((F.col("u") * 2 + F.col("down")).alias("geom_id"), "u", "v", "ax", "ay", "bx", "by", "u_signal", "v_signal", "one_way", "name", F.get(kinds, place).alias("class"), F.get(speeds, place).alias("kmh"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, direction, brand, operator. Every other triple of customers stands in a chain of 20 m steps."""
    rows = table(spark, sf_dir, "part").agg((F.floor(F.max("p_partkey") / 20) + 1).cast("long").alias("n")).first()["n"] or 1
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "case when (c_custkey div 3) % 2 = 0 then 3 * (c_custkey div 3) else c_custkey end as b", "case when (c_custkey div 3) % 2 = 0 then (c_custkey % 3) * 20 else 0 end as shift", "c_mktsegment", "c_nationkey")
    say = F.array(*[F.lit(d) for d in DIRECTIONS])
    return base.select(
        "id", ((F.col("b") * 37) % 4000 + F.col("shift")).cast("double").alias("x"), ((F.col("b") * 91) % (rows * 200)).cast("double").alias("y"),
        F.get(say, (F.col("id") % 12).cast("int")).alias("direction"), F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Flock Safety").otherwise(F.initcap("c_mktsegment")).alias("brand"), F.col("c_nationkey").alias("operator"),
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vehicle, ts, x, y, speed, heading, accuracy from events."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("vehicle"), "event_id", F.col("ts").cast("timestamp").alias("ts"), ((F.col("event_id") * 53) % 4000).cast("double").alias("x"), ((F.col("event_id") * 31) % 4000).cast("double").alias("y"),
        F.col("value").alias("speed"), ((k * 37) % 360).cast("double").alias("heading"), (F.col("event_id") % 200).cast("double").alias("accuracy"), "event_type",
    )
