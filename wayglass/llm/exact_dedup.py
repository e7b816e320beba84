"""Exact dedup in three combining steps, native expressions only.

1. Local: the partial aggregate of the first grouping deduplicates what each task has read.
2. Salted: groups of (digest, salt, text), the salt being a hash of doc_id, so that a group of
   copies that holds a third of all rows is merged by as many tasks as there are salts.
3. Global: the salt winners, at most one for each salt, are merged by (digest, text).

The whole normalised text is part of the grouping key in each step, so equal digests alone never
make two texts equal. Winners go back to their documents by digest, which is exact as long as no two
different texts share one; that is tested on the winners, and if it fails the join takes the text as well.

Defined results: a null text counts as empty, and all empty texts are one group; rows whose doc_id is
null join their group, but stay only if every doc_id of it is null; repeated rows of one doc_id and one
text count towards group_size and share one verdict; other columns of the table are not looked at, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BLANK_RE, text_of, written

SALTS = 32


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def exact_dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_replace(text_of(text), f"{BLANK_RE}+", " ").alias("norm"))
    base = base.withColumn("digest", digest(F.col("norm")))
    salted = (
        base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    merged = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = written(merged.select("digest", "keep_id", "group_size"), "exact")
    clash = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    if clash.isEmpty():
        found = base.select("doc_id", "digest", sha256(F.col("norm")).alias("text_sha256")).join(winners, "digest")
    else:
        found = base.withColumn("text_sha256", sha256(F.col("norm"))).join(merged, ["digest", "norm"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
