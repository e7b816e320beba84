"""Loops over DataFrames: what a round leaves with the driver."""

from pyspark.sql import functions as F

from wayglass.plans.iterate import component_labels, cut


def estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_estimates_of_size_do_not_grow_with_the_rounds(spark):
    state = cut(spark.range(4))
    first = estimate(state)
    for _ in range(4):
        state = cut(state.join(state.select("id"), "id"))
    assert estimate(state) <= first
    kept = cut(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, ARRAY(STRUCT(2.5D AS x)) AS c"))
    assert kept.schema.simpleString() == "struct<a:int,b:string,c:array<struct<x:double>>>" and tuple(kept.first()) == (1, None, [(2.5,)])


def test_labels_of_a_long_path(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in component_labels(spark.range(62).select(F.col("id").alias("node")), links).collect()} == {(k, 0 if k < 61 else 61) for k in range(62)}
