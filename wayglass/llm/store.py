"""Tables in the folder that all machines of a cluster share, and small expressions that several operators use."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in every operator's contract: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
BLANK_RE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Spark's setting for that, from version 4.0 on; others ignore it.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A folder of our own only in local mode, where it is unset in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        import atexit

        _local[app] = tempfile.mkdtemp(prefix="wayglass-")
        atexit.register(shutil.rmtree, _local[app], True)
    return "file://" + _local[app]


def written(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table goes away when the driver's JVM ends, the shuffle files that its making took as soon as it is there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_end(spark):
        writer.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is executed within leaves no shuffle files when it is done: Spark itself deletes them, whatever still refers to the plan. Without that they stay until the driver's garbage
    is collected, and those of all steps of a stage may lie on the executors' disks at once."""
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_END) if before is None else spark.conf.set(SHUFFLES_END, before)


def forget(df: DataFrame) -> None:
    """Delete a table that written() made and that nothing reads any more: rounds of a loop would fill the folder."""
    path = getattr(df, "_written", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are done. Spark deletes them when the driver collects its garbage; a driver with little to do may not get
    there before the next large shuffle, and the files of all of them would lie on the executors' disks at once. References that Python has dropped reach the JVM by
    a thread that sleeps between its rounds: garbage that is collected before it woke would stay."""
    gc.collect()
    dropped = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    for _ in range(60):
        if not dropped:
            break
        time.sleep(0.05)
    spark._jvm.System.gc()


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """What a task does with its batches; when it is done, the memory that it has freed goes back to the system. Python workers outlive their
    tasks, and what each stage leaves with them would add up."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library: nothing to do
            pass

    return run


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
