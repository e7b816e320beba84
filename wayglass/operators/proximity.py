"""Distance joins as equi-joins on grid cells, with the distance as residual predicate. Never a nested loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.plans.iterate import cut


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def with_cells(df: DataFrame, x: str, y: str, size: float, reach: int = 0) -> DataFrame:
    """Columns cx, cy; with reach, one row for each cell within that many cells."""
    if not reach:
        return df.withColumns({"cx": cell(F.col(x), size), "cy": cell(F.col(y), size)})
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    spread = df.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return spread.withColumns({"cx": cell(F.col(x), size) + F.col("_i"), "cy": cell(F.col(y), size) + F.col("_j")}).drop("_i", "_j")


def proximity_join(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "x2", ry: str = "y2", on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within radius. Each pair meets once: only the right side is spread, over the 3 x 3 cells around it. on: columns that have to be equal, so that unlike rows don't meet at all."""
    a, b = with_cells(left, lx, ly, radius), with_cells(right, rx, ry, radius, 1)
    return a.join(b, [*on, "cx", "cy"]).filter(F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry)) <= radius).drop("cx", "cy")


def box_join(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Points (x, y) with the boxes (x0, y0, x1, y1) that hold them. Boxes are spread over the cells that they meet; size should be of their order."""
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a), size), cell(F.col(b), size)))
    spread = boxes.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    return with_cells(points, "x", "y", size).join(spread, ["cx", "cy"]).filter(inside).drop("cx", "cy")


def nearest(points: DataFrame, targets: DataFrame, key: str, target: str, radius: float, offset: Column | None = None) -> DataFrame:
    """The nearest target of each point within radius, ties to the smallest target."""
    found = proximity_join(points, targets, radius)
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) + (offset if offset is not None else F.lit(0.0))
    return found.groupBy(key).agg(F.min_by(F.col(target), F.struct(d, F.col(target))).alias(target), F.min(d).alias("dist"))


def _finite(*names: str) -> Column:
    """Neither null, nor NaN, nor infinite: such positions are nowhere."""
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() & (F.abs(n) < float("inf")) for n in names])


def _nearest_within(points: DataFrame, targets: DataFrame, key: str, target: str, size: float) -> DataFrame:
    """key, target, dist of the points that have a target within size. A point meets the occupied tiles (a quarter of size wide) around it first, each with the least and the
    most that its targets can be away; the targets themselves are met in those tiles alone that can hold the nearest."""
    tile, slack = size / 4, 1e-9 * (1 + size)
    spots = targets.withColumns({"_fx": cell(F.col("x2"), tile), "_fy": cell(F.col("y2"), tile)})
    steps = F.sequence(F.lit(-1), F.lit(1))
    tiles = spots.select("_fx", "_fy").distinct().withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    tiles = tiles.select("_fx", "_fy", (F.floor(F.col("_fx") / 4) + F.col("_i")).alias("cx"), (F.floor(F.col("_fy") / 4) + F.col("_j")).alias("cy"))
    low = lambda p, f: F.greatest(F.col(f) * tile - F.col(p), F.col(p) - (F.col(f) + 1) * tile, F.lit(0.0))
    high = lambda p, f: F.greatest(F.abs(F.col(f) * tile - F.col(p)), F.abs(F.col(p) - (F.col(f) + 1) * tile))
    around = with_cells(points, "x", "y", size).join(tiles, ["cx", "cy"]).withColumns({"_low": F.hypot(low("x", "_fx"), low("y", "_fy")), "_high": F.hypot(high("x", "_fx"), high("y", "_fy"))})
    around = around.filter(F.col("_low") <= size + slack).withColumn("_most", F.min("_high").over(Window.partitionBy(key))).filter(F.col("_low") <= F.col("_most") + slack)  # at most 144 tiles a point
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    met = around.select(key, "x", "y", "_fx", "_fy").join(spots, ["_fx", "_fy"]).withColumn("_d", d).filter(F.col("_d") <= size)
    return met.groupBy(key).agg(F.min_by(F.col(target), F.struct("_d", target)).alias(target), F.min("_d").alias("dist"))


def nearest_at_any_distance(points: DataFrame, targets: DataFrame, key: str, target: str, size: float) -> DataFrame:
    """key, target, dist: the nearest target of each point, however far it is; ties to the smallest target. points: key (unique), x, y; targets: target, x2, y2.

    Rounds with circles of size, 4 size, 16 size and so on: what a circle settles leaves, so the wide circles are for the few points that are far from everything, and there whole
    tiles stand for their targets. size: the distance at which most points have a target. Positions that are null or not finite have no row and are nobody's nearest; without
    targets there are no rows.
    """
    spots = targets.filter(_finite("x2", "y2")).select(target, "x2", "y2")
    left = cut(points.filter(_finite("x", "y")).select(key, "x", "y"))
    found = [_nearest_within(left, spots, key, target, size)]
    if spots.isEmpty():
        return found[0]
    while not left.isEmpty():
        found.append(cut(_nearest_within(left, spots, key, target, size)))
        left, size = cut(left.join(found[-1].select(key), key, "left_anti")), size * 4
    return reduce(DataFrame.unionByName, found[1:], found[0].filter("false"))
