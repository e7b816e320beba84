"""Prompts and banners of a stream equal those of the same fixes as a table."""

import random
import time

from pyspark.sql import functions as F

from wayglass.operators import lines
from wayglass.streaming import guidance


def drained(stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")


def fed(spark, rows, schema, folder, parts):
    """The rows as a stream of `parts` batches, in their order."""
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.01)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_prompts_of_a_stream(spark, tmp_path):
    rng = random.Random(6)
    steps, fixes = [], []
    for route in range(6):
        at = [0.0]
        for _ in range(8):
            at.append(at[-1] + rng.choice([90.0, 190.0, 700.0, 1500.0]))
        steps += [(route, k, "depart" if not k else "arrive" if k == 8 else "turn", a) for k, a in enumerate(at)]
        along = 0.0
        for k in range(60):
            along += rng.uniform(0, at[-1] / 45)
            fixes.append((route, k, along, rng.choice([0.0, 8.0, 22.0, 40.0])))
    fixes.sort(key=lambda f: (f[1], f[0]))
    schema = "route_id long, fix long, along_m double, speed double"
    table = spark.createDataFrame(steps, "route_id long, step long, kind string, at_m double")
    got = drained(guidance.prompts(fed(spark, fixes, schema, tmp_path, 4), table), tmp_path)
    want = lines.prompts(table, spark.createDataFrame(fixes, schema))
    key = lambda df: sorted(tuple(r) for r in df.select("route_id", "step", "said", "fix").collect())
    assert key(got) == key(want) and len(key(got)) > 40


def test_banners_of_a_stream(spark, tmp_path):
    rng = random.Random(7)
    rows, ms = [], 0
    for k in range(300):
        ms += rng.choice([100, 400, 900, 1600])
        rows.append((k % 3, k, ms, rng.choice(["clear", "ahead", "ring", "zone", "clear"])))
    schema = "vehicle long, event_id long, ms long, state string"
    stamped = lambda df: df.withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    got = drained(guidance.banners(stamped(fed(spark, rows, schema, tmp_path, 3))), tmp_path)
    rank = F.when(F.col("state") == "zone", 3).when(F.col("state") == "ring", 2).otherwise(0)
    want = lines.held(stamped(spark.createDataFrame(rows, schema)), rank)
    key = lambda df: sorted(tuple(r) for r in df.select("event_id", "state", "shown").collect())
    assert key(got) == key(want) and sum(a != b for _, a, b in key(got)) > 10


def test_a_held_banner_goes_by_itself(spark, tmp_path):
    schema = "vehicle long, event_id long, ms long, state string"
    stream = fed(spark, [(1, 1, 1000, "zone"), (1, 2, 1400, "clear")], schema, tmp_path, 1).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    query = guidance.banners(stream, timers=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            try:
                seen = {(r["event_id"], r["shown"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
            except Exception:  # nothing is written yet
                continue
            if (None, "clear") in seen:
                break
    finally:
        query.stop()
    assert seen == {(1, "zone"), (2, "zone"), (None, "clear")}
