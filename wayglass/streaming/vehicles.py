"""Following vehicles: monotone progress, off-route strikes, one alert for each site, arrival. Keyed state, one row of state a vehicle."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Metres off the line (or this many times the accuracy), fixes in a row, seconds between reroutes, metres of arrival.
OFF_M, OFF_ACCURACY, WEAK_M, STRIKES, REROUTE_S, ARRIVE_M, NEAR_LINE_M = 45.0, 1.5, 150.0, 3, 12.0, 35.0, 90.0
AHEAD_M, AHEAD_S = 400.0, 25.0

ALERTS = "vehicle long, ts timestamp, event string, site long, at_m double"
STATE = "furthest double, strikes long, rerouted double, told string, arrived boolean"


def follow(rows: pd.DataFrame, state: dict, zones: list[tuple[int, float, float]], length_m: float) -> list[tuple]:
    """Alerts of one vehicle's fixes (ts, along, off_m, speed, accuracy) in order of time; state is updated.

    A late fix never moves progress back; a weak fix starts the strikes anew.
    """
    out = []
    for ts, along, off, speed, accuracy in sorted(rows[["ts", "along", "off_m", "speed", "accuracy"]].itertuples(index=False, name=None)):
        if state["arrived"]:
            break
        before, state["furthest"] = state["furthest"], max(state["furthest"], along)
        bad = off > max(OFF_M, OFF_ACCURACY * accuracy) and accuracy < WEAK_M
        state["strikes"] = state["strikes"] + 1 if bad else 0
        at = ts.timestamp()
        if state["strikes"] >= STRIKES and at - state["rerouted"] >= REROUTE_S:
            state["rerouted"], state["strikes"] = at, 0
            out.append((ts, "reroute", None, state["furthest"]))
        ahead = state["furthest"] + max(AHEAD_M, AHEAD_S * speed)
        for site, a, b in zones:
            level = "zone" if a <= state["furthest"] and b > before else "ahead" if before < a <= ahead else None
            if level and state["told"].get(str(site)) not in (level, "zone"):
                state["told"][str(site)] = level
                out.append((ts, level, site, state["furthest"]))
        if length_m - state["furthest"] <= ARRIVE_M and off <= NEAR_LINE_M:
            state["arrived"] = True
            out.append((ts, "arrived", None, state["furthest"]))
    return out


def alerts(fixes: DataFrame, zones: list[tuple[int, float, float]], length_m: float, forget_after: str | None = None) -> DataFrame:
    """A stream of alerts from a stream of fixes (vehicle, ts, along, off_m, speed, accuracy).

    zones: (site, from m, to m) of one route. State of a vehicle that says nothing for `forget_after` is dropped (never, if it is None: a query over what is available then ends).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {"furthest": 0.0, "strikes": 0, "rerouted": 0.0, "told": {}, "arrived": False}
        if state.exists:
            furthest, strikes, rerouted, told, arrived = state.get
            held = {"furthest": furthest, "strikes": strikes, "rerouted": rerouted, "told": json.loads(told), "arrived": arrived}
        rows = pd.concat(list(batches))
        found = follow(rows, held, zones, length_m)
        state.update((held["furthest"], held["strikes"], held["rerouted"], json.dumps(held["told"]), held["arrived"]))
        if forget_after:
            state.setTimeoutDuration(int(pd.Timedelta(forget_after).total_seconds() * 1000))
        yield pd.DataFrame([(key[0], *x) for x in found], columns=["vehicle", "ts", "event", "site", "at_m"]).astype({"vehicle": "int64", "event": "object", "at_m": "float64"})

    grouped = fixes.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("vehicle")
    return grouped.applyInPandasWithState(step, ALERTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if forget_after else GroupStateTimeout.NoTimeout)


def alerts_per_window(stream: DataFrame, late: str = "10 minutes", width: str = "10 minutes") -> DataFrame:
    """Alerts counted by kind and window of event time; late fixes count until the watermark passes."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event").agg(F.count(F.lit(1)).alias("n"))
