"""Feeds that come in versions: micro-batches merged into the newest version of each object, behind a gate against shrunken feeds."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.operators.jobs import LEAST_SHARE
from wayglass.operators.release import newest
from wayglass.plans.iterate import cut


def gate(fresh: DataFrame, before: DataFrame | None) -> str:
    """ok, empty or shrunk."""
    n = fresh.count()
    if not n:
        return "empty"
    return "shrunk" if before is not None and n < LEAST_SHARE * before.count() else "ok"


class Refused(RuntimeError):
    """A table that the gate didn't take. What was there stays, and so does the position."""

    def __init__(self, verdict: str, number: int):
        super().__init__(f"version {number} was refused: {verdict}")
        self.verdict, self.number = verdict, number


class Snapshots:
    """Versions of a table in a folder: snapshot=<n>, and snapshot=<n>.<k> where a version was written again. Readers use the newest; a refused one leaves the last good one
    in place, and what is there is never overwritten, so readers may go on with it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _found(self) -> list[tuple[int, int]]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        done = [n.split("=")[1].split(".") for n in names if n.startswith("snapshot=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted((int(n[0]), int(n[1]) if len(n) > 1 else 0) for n in done)

    def _versions(self) -> list[int]:
        return sorted({n for n, _ in self._found()})

    def _path(self, number: int, again: int) -> str:
        return f"{self.folder}/snapshot={number}" + (f".{again}" if again else "")

    def current(self) -> DataFrame | None:
        found = self._found()
        return self.spark.read.parquet(self._path(*found[-1])) if found else None

    def publish(self, fresh: DataFrame, number: int, force: bool = False) -> str:
        """ok, or why the table isn't taken. force: take it even if it has shrunk."""
        if number in self._versions():
            fresh = cut(fresh)
        verdict = gate(fresh, self.current())
        if verdict == "shrunk" and force:
            verdict = "ok"
        if verdict == "ok":
            again = [k for n, k in self._found() if n == number]
            fresh.write.mode("overwrite").parquet(self._path(number, again[-1] + 1 if again else 0))
        return verdict

    def merge(self, changes: DataFrame, number: int, key: str = "id", version: str = "version", force: bool = False) -> str:
        """Newest version of each object, of what is there and what comes. Rows with deleted = true go once they are the newest."""
        before = self.current()
        both = changes if before is None else before.unionByName(changes, allowMissingColumns=True)
        kept = newest(both, [key], [F.col(version)])
        return self.publish(kept.filter(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in kept.columns else kept, number, force)


class Unreachable(RuntimeError):
    """The server of change files didn't say how far it is."""


#: Seconds between attempts to read the server's state, change files that are merged at once.
RETRY_S, CHUNK = (10.0, 30.0, 60.0), 64


class Replica:
    """A table that follows numbered change files: <source>/<number>.parquet, each with whole versions of changed objects.

    The position is the number of the newest snapshot, so a merge and its position are one and the same write. A backlog is merged in chunks;
    if files that are needed are gone, the table starts anew from a full copy.
    """

    def __init__(self, snapshots: Snapshots, source: str, latest: Callable[[], int | None], fresh: Callable[[], tuple[DataFrame, int]], sleep: Callable[[float], None] = time.sleep):
        self.snapshots, self.source, self.latest, self.fresh, self.sleep = snapshots, source.rstrip("/"), latest, fresh, sleep

    def position(self) -> int | None:
        done = self.snapshots._versions()
        return done[-1] if done else None

    def _asked(self) -> int:
        for wait in (*RETRY_S, None):
            found = self.latest()
            if found is not None:
                return found
            if wait is not None:
                self.sleep(wait)
        raise Unreachable(self.source)

    def restart(self, force: bool = False) -> int:
        table, number = self.fresh()
        verdict = self.snapshots.publish(table, number, force)
        if verdict != "ok":
            raise Refused(verdict, number)
        return number

    def update(self, rewind: int = 0, chunk: int = CHUNK, force: bool = False) -> tuple[int, bool]:
        """(position, whether anything changed). rewind: so many of the files before are merged again, which changes nothing that is there.

        A chunk that the gate refuses is an error: the position stays before it, no later file is read, and the next run meets it again. force: take it all the same.
        """
        at = self.position()
        if at is None:
            return self.restart(force), True
        last, start = self._asked(), max(1, at + 1 - rewind)
        if last < start:
            return at, False
        spark = self.snapshots.spark
        there = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{self.source}/{n}.parquet")
        fs = there(start).getFileSystem(spark._jsc.hadoopConfiguration())
        while start <= last:
            stop = min(start + chunk - 1, last)
            if not all(fs.exists(there(n)) for n in range(start, stop + 1)):
                return self.restart(force), True
            verdict = self.snapshots.merge(spark.read.parquet(*[f"{self.source}/{n}.parquet" for n in range(start, stop + 1)]), max(stop, at), force=force)
            if verdict != "ok":
                raise Refused(verdict, max(stop, at))
            start = stop + 1
        return self.position(), True


def follow_changes(stream: DataFrame, snapshots: Snapshots, checkpoint: str, key: str = "id", version: str = "version", force: bool = False):
    """A query that merges each micro-batch. A repeated batch is written beside itself and merges to the same table; a refused one fails the query, so that the checkpoint doesn't pass it."""

    def merge(batch: DataFrame, number: int) -> None:
        verdict = snapshots.merge(batch, number, key, version, force)
        if verdict == "shrunk" or verdict == "empty" and snapshots.current() is not None:
            raise Refused(verdict, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
