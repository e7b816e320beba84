"""Evaluation of routes over a sweep of prices: baselines, summaries, budgets, percentiles, the trip to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.plans.iterate import cut

#: Shares of extra time of the budget table, and the share up to which a trip may be shown.
BUDGETS = (0.05, 0.1, 0.2, 0.5)
SHOWN_EXTRA, SHOWN_SITES = 0.1, 4


def with_baseline(rows: DataFrame, by: list[str], values: list[str], price: str = "lam", order: str = "id") -> DataFrame:
    """rows with <value>0: the value of the first row without a price of the same `by`; null where there is none."""
    free = F.col(price) == 0
    base = rows.groupBy(*by).agg(*[F.min_by(F.when(free, F.col(v)), F.when(free, F.col(order))).alias(f"{v}0") for v in values])
    return rows.join(base, by)


def overhead(time: str = "t") -> Column:
    return F.col(time) / F.col(f"{time}0") - 1


def sweep_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """For each price: trips, mean, median and 90th percentile of what was met, extra time, share of trips that meet nothing, sites per 10 km.

    rows: t, t0, d (sites), l (metres). Sites per 10 km are a ratio of sums, percentiles are interpolated.
    """
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("sites"), F.percentile("d", F.lit(0.5)).alias("sites_median"), F.percentile("d", F.lit(0.9)).alias("sites_p90"),
        F.avg(overhead()).alias("overhead"), F.percentile(overhead(), F.lit(0.9)).alias("overhead_p90"), F.avg((F.col("d") == 0).cast("double")).alias("clear"), (10_000.0 * F.sum("d") / F.sum("l")).alias("per_10km"),
    )


def within_budgets(rows: DataFrame, by: list[str], budgets: tuple[float, ...] = BUDGETS) -> DataFrame:
    """by, budget, sites: the fewest sites of a trip within each share of extra time, null if no row is. Each budget is a column until the end: rows aren't multiplied."""
    extra = overhead()
    fewest = [F.min(F.when(extra <= b + 1e-9, F.col("d"))).alias(f"b{i}") for i, b in enumerate(budgets)]
    table = rows.groupBy(*by).agg(*fewest)
    pairs = F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"b{i}").alias("sites")) for i, b in enumerate(budgets)])
    return table.select(*by, F.inline(pairs))


def budget_summary(best: DataFrame, by: list[str]) -> DataFrame:
    """Means over trips of within_budgets (with d0 joined): by and budget, sites, share of trips that meet nothing, share of sites saved."""
    return best.groupBy(*by, "budget").agg(F.avg("sites").alias("sites"), F.avg((F.col("sites") == 0).cast("double")).alias("clear"), (1 - F.avg("sites") / F.avg("d0")).alias("saved"))


def picked_percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """by, and for each share the element at place min(n - 1, floor(share * n)) of the group in order.

    Counts of distinct values are summed up in order, so a group is as large as its distinct values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(by)
    upto = counts.withColumns({"_upto": F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(w)})
    place = lambda p: F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n")))
    return upto.groupBy(by).agg(*[F.min(F.when(F.col("_upto") > place(p), F.col("_v"))).alias(name) for name, p in shares.items()])


def medians(rows: DataFrame, by: str, value: str, name: str = "median") -> DataFrame:
    """by, n, median: the middle value of each group, the mean of the two in the middle if n is even. Nulls don't count; a group of nulls alone has no row.

    Exact, and no task holds a group: distinct values are counted, sorted by ranges and numbered by sums over the ranges, so one value or one group may have most of the rows.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranged = cut(counts.repartitionByRange(by, "_v").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.sum("_c").alias("_s"))  # a row for each partition
    sizes = sizes.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at"))
    within = F.sum("_c").over(Window.partitionBy("_p").orderBy(by, "_v").rowsBetween(Window.unboundedPreceding, 0))
    upto = ranged.join(F.broadcast(sizes), "_p").withColumn("_upto", F.col("_at") + within)
    groups = upto.groupBy(by).agg(F.min(F.col("_upto") - F.col("_c")).alias("_first"), F.sum("_c").alias("n"))
    holds = lambda place: (F.col("_upto") - F.col("_c") <= F.col("_first") + place) & (F.col("_upto") > F.col("_first") + place)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = upto.join(groups, by).filter(holds(low) | holds(high))
    return middle.groupBy(by).agg(F.first("n").alias("n"), ((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias(name))


def histogram(rows: DataFrame, trip: str, option: str) -> DataFrame:
    """options, trips: how many trips have how many options."""
    return rows.groupBy(trip).agg(F.count_distinct(option).alias("options")).groupBy("options").agg(F.count(F.lit(1)).alias("trips"))


def showcase(rows: DataFrame, pair: str = "pair") -> DataFrame:
    """pair, lam, gain of the one trip to show: of each trip that meets enough, the priced row with the fewest sites and then the least extra time within the limit; then the largest gain, the first pair among equals."""
    fit = (F.col("lam") > 0) & (overhead() <= SHOWN_EXTRA)
    rank = F.struct("d", overhead(), "id")
    best = rows.groupBy(pair).agg(F.max("d0").alias("d0"), F.min(F.when(fit, rank)).alias("best"), F.min_by("lam", F.when(fit, rank)).alias("lam")).filter((F.col("d0") >= SHOWN_SITES) & F.col("best").isNotNull())
    return best.select(pair, "lam", (F.col("d0") - F.col("best.d")).alias("gain")).orderBy(F.desc("gain"), pair).limit(1)
