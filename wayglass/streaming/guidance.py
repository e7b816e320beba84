"""Spoken prompts and held banners on live fixes, by keyed state: what lines.prompts and lines.held say of a table, said of a stream.

State is one map entry for each maneuver that was announced, and the banners of the last seconds, so it stays small however long a drive is. With
`timers` a banner that is only held goes by itself once its time is over, even if no fix comes. Fixes are taken in the order of their batches, and by
number or time within one; of fixes of one moment in different batches the earlier ones don't know of the later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayglass.operators.lines import HOLD_S

#: Metres to the maneuver that is said along; m/s that stand for an unknown speed; bounds and seconds of both announcements.
THEN_M, USUAL_MPS = 200.0, 12.0
EARLY, NOW = (250.0, 1600.0, 30.0), (40.0, 250.0, 7.0)
#: Ranks of banners, and the least rank that is held.
RANKS, HELD_RANK = {"zone": 3, "ring": 2}, 2

SAID = "route_id long, step long, said string, fix long, joined long"
SHOWN = "vehicle long, event_id long, ms long, state string, shown string"


def use_rocksdb(spark: SparkSession) -> None:
    """Map and list state need the state store that keeps them beside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def announcements(steps: list[tuple[int, str, float]], along: float, speed: float, early: set[int], now: set[int]) -> list[tuple[int, str, int | None]]:
    """(step, early or now, step said along) due at a place; early and now, the steps that were dealt with, are updated. steps: (step, kind, at_m) in order."""
    ahead = next((k for k, (_, kind, at) in enumerate(steps) if kind != "depart" and at > along), None)
    if ahead is None:
        return []
    step, _, at = steps[ahead]
    after = steps[ahead + 1] if ahead + 1 < len(steps) else None
    v = speed if speed > 1 else USUAL_MPS
    far, near = (min(most, max(least, v * s)) for least, most, s in (EARLY, NOW))
    left = at - along
    if left <= near:
        if step in now:
            return []
        now.add(step)
        early.add(step)
        joined = after[0] if after and after[2] - at <= THEN_M else None
        if joined is not None:
            early.add(joined)
        return [(step, "now", joined)]
    if left <= far and step not in early:
        early.add(step)
        return [(step, "early", None)] if left > 1.5 * near else []
    return []


class Prompter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getMapState("told", "step long", "now boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        early, now = set(), set()
        for (step,), (is_now,) in self.told.iterator():
            early.add(step)
            if is_now:
                now.add(step)
        before, out = (set(early), set(now)), []
        fixes = pd.concat(list(rows)).sort_values("fix", kind="stable")
        for fix, along, speed, steps in zip(*(fixes[c].tolist() for c in ("fix", "along_m", "speed", "steps")), strict=True):
            plan = sorted((s["step"], s["kind"], s["at_m"]) for s in steps)
            out += [(key[0], step, said, fix, joined) for step, said, joined in announcements(plan, along, speed or 0.0, early, now)]
        for step in (early - before[0]) | (now - before[1]):
            self.told.updateValue((step,), (step in now,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SAID.split(", ")]).astype({"joined": "Int64", "said": "object"})

    def close(self) -> None:
        pass


def prompts(fixes: DataFrame, steps: DataFrame) -> DataFrame:
    """A stream of announcements (SAID) from a stream of fixes (route_id, fix, along_m, speed). steps: a table of route_id, step, kind, at_m."""
    use_rocksdb(fixes.sparkSession)
    plans = steps.groupBy("route_id").agg(F.collect_list(F.struct("step", "kind", "at_m")).alias("steps"))  # the steps of one route: a row as it is
    rows = fixes.select("route_id", "fix", "along_m", "speed").join(plans, "route_id")
    return rows.groupBy("route_id").transformWithStateInPandas(Prompter(), SAID, "append", "None")


class Banner(StatefulProcessor):
    def __init__(self, hold_ms: int, timers: bool):
        self.hold_ms, self.timers = hold_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "ms long, rank int, state string")
        self.last = handle.getValueState("last", "ms long, state string, shown string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        fixes, out = pd.concat(list(rows)).sort_values(["ms", "event_id"], kind="stable"), []
        for ms, same in fixes.groupby("ms", sort=True):
            ms = int(ms)
            now = [(ms, RANKS.get(s, 0), s) for s in same["state"]]
            recent = [r for r in recent if r[0] > ms - self.hold_ms] + [r for r in now if r[1] >= HELD_RANK]
            top = max(((r[1], r[2]) for r in recent), default=(0, None))
            for event, (_, rank, state) in zip(same["event_id"], now, strict=True):
                out.append((key[0], event, ms, state, top[1] if top[0] > rank else state))
        if recent:
            self.recent.put(recent)
        elif self.recent.exists():
            self.recent.clear()
        *_, ms, state, shown = out[-1]
        self.last.update((ms, state, shown))
        if self.timers:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            if shown != state:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.hold_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SHOWN.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms, state, shown = self.last.get()
        if shown != state:
            self.last.update((ms, state, state))
            yield pd.DataFrame([(key[0], None, ms + self.hold_ms, state, state)], columns=[c.split()[0] for c in SHOWN.split(", ")]).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def banners(states: DataFrame, hold_s: float = HOLD_S, timers: bool = False) -> DataFrame:
    """A stream of what is shown (SHOWN) from a stream of states (vehicle, event_id, ts, state). With timers a banner that was held is followed by a row without event_id when its time is over."""
    use_rocksdb(states.sparkSession)
    rows = states.select("vehicle", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "state")
    return rows.groupBy("vehicle").transformWithStateInPandas(Banner(round(hold_s * 1000), timers), SHOWN, "append", "ProcessingTime" if timers else "None")
