"""Connected components of a table of links, by stars that grow and shrink in turn. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, release, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: for every node of a link the smallest node that it is connected with.

    Each round links every node's larger neighbours to its smallest one, then every node's smaller
    neighbours; the number of rounds grows with the logarithm of the longest path. Rounds are written to the shared folder.
    """
    u, v = F.col("u"), F.col("v")
    stars = written(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    release(links.sparkSession)
    before = None
    while True:
        mark = stars.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        both = stars.unionByName(stars.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min(F.least(u, v)).alias("m"))
        large = both.join(low, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v")).filter(u != v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(v.alias("u"), F.col("m").alias("v")).filter(u != v)
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        forget(stars)
        stars = after
    return stars.select(u.alias("node"), v.alias("label")).unionByName(stars.select(v.alias("node"), v.alias("label")).distinct())
