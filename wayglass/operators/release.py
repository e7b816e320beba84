"""Versions of a dataset: comparison, verification, the decision to publish, retention. Batch twins of what the streams do with fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A change that is worth publishing at once, and the age at which any change is.
CHANGED_SHARE, LIVE_DAYS = 0.01, 7
#: Limits of verification.
EDGES_LOW, EDGES_HIGH, RATIO_LOW, RATIO_HIGH, OUTLIER, OUTLIERS_MOST, LOST_MOST, MIN_EDGES = 0.85, 1.2, 0.85, 1.15, 1.5, 0.1, 0.05, 100


def changed_share(fresh: DataFrame, live: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, n_fresh, n_live, changed: size of the multiset difference of keys, over all keys of both."""
    count = lambda df, name: df.groupBy(*by, key).agg(F.count(F.lit(1)).alias(name))
    both = count(fresh, "a").join(count(live, "b"), [*by, key], "full_outer").fillna(0, ["a", "b"])
    sums = both.groupBy(*by).agg(F.sum("a").alias("n_fresh"), F.sum("b").alias("n_live"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("diff"))
    return sums.select(*by, "n_fresh", "n_live", (F.col("diff") / F.greatest(F.lit(1), F.col("n_fresh") + F.col("n_live"))).alias("changed"))


def is_outlier(ratio: Column) -> Column:
    """Longer or shorter by more than the factor OUTLIER."""
    return (ratio > OUTLIER) | (ratio * OUTLIER < 1)


def verdict(n_fresh: Column, n_live: Column, ratio: Column, outliers: Column, lost: Column) -> Column:
    """Reasons to hold a version back, empty if there are none."""
    size = n_fresh / n_live
    rules = (
        (n_fresh < MIN_EDGES, "too few edges"), ((size < EDGES_LOW) | (size > EDGES_HIGH), "number of edges"), ((ratio < RATIO_LOW) | (ratio > RATIO_HIGH), "travel times"),
        (outliers > OUTLIERS_MOST, "outliers"), (lost > LOST_MOST, "lost trips"),
    )
    return F.array_compact(F.array(*[F.when(c, why) for c, why in rules]))


def decision(same: Column, ok: Column, has_live: Column, full: Column, changed: Column, age_days: Column) -> Column:
    return (
        F.when(has_live & same, "unchanged").when(~ok, "hold").when(~has_live | full | (changed >= CHANGED_SHARE) | age_days.isNull() | (age_days >= LIVE_DAYS), "publish").otherwise("defer")
    )


def newest(df: DataFrame, key: list[str], version: list[Column]) -> DataFrame:
    """The last version of each object."""
    w = Window.partitionBy(*key).orderBy(*[v.desc() for v in version])
    return df.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")


def fingerprint(df: DataFrame, by: str, value: Column) -> DataFrame:
    """by, fingerprint: a hash of all values of a group, whatever their order."""
    return df.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(value.cast("string"))), ","), 256).alias("fingerprint"))


def delta(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(w))


def undelta(df: DataFrame, by: str, order: str, value: str = "delta") -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.sum(value).over(w))


def progress(fixes: DataFrame) -> DataFrame:
    """fixes (vehicle, ts, event_id, along) with `furthest`: progress never goes back when a fix comes late."""
    w = Window.partitionBy("vehicle").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return fixes.withColumn("furthest", F.max("along").over(w))


def off_route(fixes: DataFrame, in_a_row: int = 3) -> DataFrame:
    """fixes (vehicle, ts, event_id, off_m, accuracy) with `strikes`: consecutive fixes off the route; a good or weak fix starts anew."""
    w = Window.partitionBy("vehicle").orderBy("ts", "event_id")
    bad = (F.col("off_m") > F.greatest(F.lit(45.0), 1.5 * F.col("accuracy"))) & (F.col("accuracy") < 150)
    rows = fixes.withColumn("bad", bad).withColumn("run", F.sum((~F.col("bad")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("vehicle", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("strikes", F.sum(F.col("bad").cast("int")).over(inside).cast("long"))
    return rows.withColumn("reroute", F.col("strikes") >= in_a_row).drop("run")


def report(outcomes: DataFrame) -> str:
    """A report of a build in Markdown: counts by status, what held regions back first, the largest after that. outcomes: region, status, why, edges (a row a region)."""
    order = F.when(F.col("status") == "failed", 0).when(F.col("status") == "held", 1).otherwise(2)
    rows = outcomes.orderBy(order, F.desc("edges"), "region").collect()  # as many rows as there are regions
    tally: dict[str, int] = {}
    for r in rows:
        tally[r["status"]] = tally.get(r["status"], 0) + 1
    head = ["# Build", "", ", ".join(f"{n} {s}" for s, n in sorted(tally.items())) or "nothing built", "", "| region | status | edges | why |", "|-|-|-|-|"]
    return "\n".join([*head, *[f"| {r['region']} | {r['status']} | {r['edges'] or 0:,} | {r['why'] or ''} |" for r in rows]]) + "\n"
