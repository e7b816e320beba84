"""Loops over DataFrames: each round is written to the shared checkpoint folder, so lineage stays short and lost executors cost one round."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def own_folder(spark: SparkSession) -> str:
    """A folder of this machine, for local mode alone."""
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="wayglass-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else "file://" + own_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint(), in spark.checkpoint.dir; a folder of our own only where that is unset in local mode.

    A checkpoint takes over the estimated size of the plan that made it. Joins multiply such estimates, so in a loop the number gets twice as many digits or more with each round, until it
    fills the driver: what is returned has the same rows without an estimate.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(own_folder(spark))
    kept = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new empty folder in the shared folder. It goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def written_lines(lines: DataFrame, name: str) -> str:
    """Write a table of one text column as files of lines to the shared folder; their path. They go when the driver's JVM ends."""
    spark = lines.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], mark: list[str], most: int = 10_000) -> DataFrame:
    """Apply step until the columns `mark` of all rows stay the same. An error if they don't within `most` rounds: an unfinished state is never returned."""
    state, before = cut(state), None
    for _ in range(most):
        now = state.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*mark)).alias("x")).first()
        if now == before:
            return state
        before, state = now, cut(step(state))
    raise RuntimeError(f"no stable state after {most} rounds")


def numbered(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """df with its rows' numbers from 0 in an order over the whole table: sorted by ranges, numbered within them and moved by the sizes of those before, so no task has all rows."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    sizes = rows.groupBy("_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(F.broadcast(sizes.drop("_n")), "_p").withColumn(name, F.col("_m") - F.col("_first") + F.col("_at")).drop("_p", "_m", "_first", "_at")


def component_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component). nodes: node. links: a, b. Labels spread along links, and jump to their label's label.

    Only nodes with links take part in the rounds; the others keep their own label.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    # the first round needs no labels: the smallest of a node and its neighbours
    start = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))

    def step(state: DataFrame) -> DataFrame:
        heard = both.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        near = state.join(heard, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("label"))
        far = near.select(F.col("node").alias("via"), F.col("label").alias("further"))
        return near.join(far, F.col("label") == F.col("via"), "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))

    found = until_stable(start, step, ["node", "label"])
    return nodes.select("node").join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", F.coalesce("label", "node").alias("label"))
