"""Tables in the shared folder, and the disk that their making takes."""

from pyspark.sql import functions as F

from wayglass.llm.store import SHUFFLES_END, written


def shuffled_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    """Nor when what it was made of is still held."""
    before, setting = shuffled_bytes(spark), spark.conf.get(SHUFFLES_END)
    held = spark.range(200_000).selectExpr("id % 5000 AS k", "uuid() AS u").repartition(4, "k").groupBy("k").agg(F.max("u").alias("u"), F.count("u").alias("n"))
    table = written(held.join(spark.range(5000).withColumnRenamed("id", "k").hint("merge"), "k"))
    assert shuffled_bytes(spark) <= before
    assert table.agg(F.sum("n")).first()[0] == 200_000 and held.count() == 5000
    assert spark.conf.get(SHUFFLES_END) == setting
