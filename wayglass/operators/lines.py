"""Positions on polylines: matching fixes, taps on a map, playback, what comes next on a route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.operators.proximity import cell

#: Metres that a fix may fall back before it costs extra, from which a stop is "near" something, seconds that a banner stays.
SLACK_M, NEAR_M, HOLD_S = 40.0, 25.0, 1.5


def segments(points: DataFrame, line: str = "line") -> DataFrame:
    """line, k, x0, y0, x1, y1, from_m, len of polylines (line, k, x, y), whose points may repeat."""
    w = Window.partitionBy(line).orderBy("k")
    ends = points.select(line, "k", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).filter("x1 is not null")
    ends = ends.withColumn("len", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return ends.withColumn("from_m", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def share(x: Column, y: Column) -> Column:
    """Share of a segment (x0, y0, x1, y1) at which it comes nearest to a point."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    square = dx * dx + dy * dy
    t = F.when(square > 0, ((x - F.col("x0")) * dx + (y - F.col("y0")) * dy) / square).otherwise(0.0)
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def off(x: Column, y: Column, t: Column) -> Column:
    """Distance of a point from the place at share t of a segment."""
    return F.hypot(F.col("x0") + t * (F.col("x1") - F.col("x0")) - x, F.col("y0") + t * (F.col("y1") - F.col("y0")) - y)


def matched(fixes: DataFrame, lines: DataFrame, fix: str = "event_id", line: str = "line") -> DataFrame:
    """fix, along_m, off_m: where fixes (fix, line, x, y, from_m of progress so far) fall on their line.

    The nearest place wins, but going back more than SLACK_M behind the progress costs as much extra; the first of equal places. A fix meets
    the segments of its own line alone.
    """
    at = fixes.select(fix, line, "x", "y", F.col("from_m").alias("since_m")).join(segments(lines, line), line)
    at = at.withColumn("t", share(F.col("x"), F.col("y"))).withColumn("off_m", off(F.col("x"), F.col("y"), F.col("t"))).withColumn("along_m", F.col("from_m") + F.col("t") * F.col("len"))
    cost = F.col("off_m") + F.greatest(F.lit(0.0), F.col("since_m") - SLACK_M - F.col("along_m"))
    return at.groupBy(fix).agg(F.min(F.struct(cost.alias("cost"), "k", "along_m", "off_m")).alias("b")).select(fix, "b.along_m", "b.off_m")


def tapped(taps: DataFrame, lines: DataFrame, reach: float, tap: str = "tap", line: str = "line") -> DataFrame:
    """tap, line: the line nearest to each tap (tap, x, y, selected) within reach, not the selected one; the last of equal ones. Lines meet taps in grid cells that they come near."""
    side = 2 * reach
    s = segments(lines, line)
    steps = F.ceil(F.col("len") / reach).cast("int") + 1
    spots = s.withColumn("n", steps).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("t", F.col("t") / F.col("n"))
    spots = spots.withColumns({"cx": cell(F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0")), side), "cy": cell(F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0")), side)})
    cells = spots.drop("t", "n").distinct()
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    at = taps.withColumn("_i", around).withColumn("_j", around).withColumns({"cx": cell(F.col("x"), side) + F.col("_i"), "cy": cell(F.col("y"), side) + F.col("_j")})
    near = at.join(cells, ["cx", "cy"]).filter(F.col(line) != F.col("selected"))
    near = near.withColumn("d", F.round(off(F.col("x"), F.col("y"), share(F.col("x"), F.col("y"))), 6)).filter(F.col("d") <= reach)
    return near.groupBy(tap).agg(F.min_by(line, F.struct("d", (-F.col(line)).alias("o"))).alias(line))


def positions(lines: DataFrame, times: DataFrame, line: str = "line") -> DataFrame:
    """line, t, along_m, x, y: where a playback is at its times (line, t, along_m driven so far), which end at the line's end."""
    s = segments(lines, line)
    ends = s.groupBy(line).agg(F.max(F.col("from_m") + F.col("len")).alias("length_m"))
    at = times.join(ends, line).withColumn("d", F.least(F.greatest(F.col("along_m"), F.lit(0.0)), F.col("length_m"))).drop("along_m")
    # the last segment that starts at or before the place
    here = at.join(s.withColumnRenamed("from_m", "start_m"), line).filter("start_m <= d")
    seg = here.groupBy(line, "t", "d").agg(F.max_by(F.struct("start_m", "len", "x0", "y0", "x1", "y1"), "k").alias("s"))
    u = F.when(F.col("s.len") > 0, (F.col("d") - F.col("s.start_m")) / F.col("s.len")).otherwise(0.0)
    along = lambda a, b: F.col(f"s.{a}") + u * (F.col(f"s.{b}") - F.col(f"s.{a}"))
    return seg.select(line, "t", F.col("d").alias("along_m"), along("x0", "x1").alias("x"), along("y0", "y1").alias("y"))


def upcoming(steps: DataFrame, fixes: DataFrame, route: str = "route_id") -> DataFrame:
    """fix columns with next_step, next_at_m, then_step, then_at_m: the maneuver ahead of each fix (route, fix, along_m) and the one after it. steps: route, step, kind, at_m."""
    w = Window.partitionBy(route).orderBy("step")
    after = steps.withColumns({"then_step": F.lead("step").over(w), "then_at_m": F.lead("at_m").over(w)}).filter("kind <> 'depart'")
    ahead = F.col("at_m") > F.col("along_m")
    met = fixes.join(after, route, "left")
    first = met.groupBy(*fixes.columns).agg(F.min(F.when(ahead, F.struct("step", "at_m", "then_step", "then_at_m"))).alias("n"))
    return first.select(*fixes.columns, F.col("n.step").alias("next_step"), F.col("n.at_m").alias("next_at_m"), F.col("n.then_step").alias("then_step"), F.col("n.then_at_m").alias("then_at_m"))


def prompt_distances(speed: Column) -> tuple[Column, Column]:
    """Metres before a maneuver at which it is said for the first and the second time, at a speed in m/s (slower than 1: unknown)."""
    v = F.when(speed > 1, speed).otherwise(12.0)
    return F.least(F.lit(1600.0), F.greatest(F.lit(250.0), v * 30)), F.least(F.lit(250.0), F.greatest(F.lit(40.0), v * 7))


def prompts(steps: DataFrame, fixes: DataFrame, route: str = "route_id") -> DataFrame:
    """route, step, said (early or now), fix: the fixes (route, fix, along_m, speed, in order of fix) at which a maneuver is announced, once each.

    A maneuver within 200 m of the one before is said along with it, and one that is close already has no early announcement.
    """
    far, near = prompt_distances(F.col("speed"))
    n = upcoming(steps, fixes, route).filter("next_step is not null").withColumns({"left_m": F.col("next_at_m") - F.col("along_m"), "far": far, "near": near})
    now = n.filter("left_m <= near").groupBy(route, F.col("next_step").alias("step")).agg(F.min("fix").alias("fix"), F.min_by(F.when(F.col("then_at_m") - F.col("next_at_m") <= 200, F.col("then_step")), "fix").alias("joined"))
    early = n.filter("left_m > near and left_m <= far").groupBy(route, F.col("next_step").alias("step")).agg(F.min("fix").alias("fix"), F.min_by(F.col("left_m") > 1.5 * F.col("near"), "fix").alias("apart"))
    with_it = now.filter("joined is not null").groupBy(route, F.col("joined").alias("step")).agg(F.min("fix").alias("told"))
    done = now.select(route, "step", F.col("fix").alias("at"))
    first = early.join(done, [route, "step"], "left").join(with_it, [route, "step"], "left").filter("apart and (told is null or fix < told) and (at is null or fix < at)")
    return first.select(route, "step", F.lit("early").alias("said"), "fix").unionByName(now.select(route, "step", F.lit("now").alias("said"), "fix"))


def route_line(legs: DataFrame, points: DataFrame, route: str = "route_id") -> DataFrame:
    """route, i, x, y: the line of a route: its legs' geometries one after another, turned round where they are driven backwards, without repeated points.

    legs: route, seq, geom, rev. points: geom, k, x, y.
    """
    at = legs.join(points, "geom").withColumn("_k", F.when(F.col("rev"), -F.col("k")).otherwise(F.col("k")))
    w = Window.partitionBy(route).orderBy("seq", "_k")
    same = F.struct("x", "y") == F.lag(F.struct("x", "y")).over(w)
    kept = at.withColumn("_same", F.coalesce(same, F.lit(False))).filter("not _same")
    return kept.withColumn("i", F.row_number().over(w) - 1).select(route, "i", "x", "y")


def stop_name(name: Column, distance_m: Column) -> Column:
    """What a tapped stop is called."""
    return F.when(F.coalesce(distance_m, F.lit(0.0)) < NEAR_M, name).otherwise(F.concat(F.lit("Near "), name))


def held(states: DataFrame, rank: Column, least: int = 2, hold_s: float = HOLD_S) -> DataFrame:
    """states (vehicle, ts, event_id, state) with `shown`: a state of rank `least` or more stays for less than hold_s seconds against states of lower ranks."""
    w = Window.partitionBy("vehicle").orderBy("_ms").rangeBetween(1 - round(hold_s * 1000), 0)
    lately = states.withColumns({"_ms": F.unix_millis(F.col("ts").cast("timestamp")), "_r": rank})
    lately = lately.withColumn("_top", F.max(F.when(F.col("_r") >= least, F.struct("_r", "state"))).over(w))
    return lately.withColumn("shown", F.when(F.col("_top._r") > F.col("_r"), F.col("_top.state")).otherwise(F.col("state"))).drop("_ms", "_r", "_top")
