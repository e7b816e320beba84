"""Cheapest paths by cells against a plain search, and their traces."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from wayglass.operators import sweep
from wayglass.plans.iterate import cut


def plain(arcs, start, price):
    out = {start: 0.0}
    heap = [(0.0, start)]
    while heap:
        c, v = heapq.heappop(heap)
        if c > out[v]:
            continue
        for _, a, b, t, x in arcs:
            if a == v and c + t + price * x < out.get(b, 1e18):
                out[b] = c + t + price * x
                heapq.heappush(heap, (out[b], b))
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    n = 60
    at = {v: (rng.random() * 100, rng.random() * 100) for v in range(n)}
    near = lambda v: sorted(range(n), key=lambda u: (at[u][0] - at[v][0]) ** 2 + (at[u][1] - at[v][1]) ** 2)[1:5]
    arcs = [(v, u, rng.randrange(1, 50), rng.choice([0, 0, 1, 3])) for v in range(n - 2) for u in near(v) if u < n - 1]
    arcs += [(3, near(3)[0], 400, 0), (5, 5, 1, 0)]  # a parallel arc and a loop; the last two nodes lead nowhere, the last can't be reached
    arcs = [(k, a, b, float(t), float(x)) for k, (a, b, t, x) in enumerate(arcs)]
    vertices = spark.createDataFrame([(v, *map(float, p)) for v, p in at.items()], "v long, x double, y double")
    return arcs, vertices, spark.createDataFrame(arcs, "arc long, a long, b long, t double, x double")


def test_cells_are_bounded_and_all_vertices_have_one(world):
    _, vertices, _ = world
    sizes = [r["count"] for r in sweep.cells(vertices, 7).groupBy("cell").count().collect()]
    assert max(sizes) <= 7 and sum(sizes) == 60


@pytest.mark.parametrize("size,at_once", [(7, 2), (1000, 64)])
def test_costs_and_traces_against_a_plain_search(spark, world, size, at_once):
    arcs, vertices, table = world
    cells = sweep.cells(vertices, size)
    runs = [(p, s) for p in (0.0, 20.0) for s in (0, 17, 58)]
    starts = spark.createDataFrame([(p, s, s, 0.0) for p, s in runs], "price double, source long, v long, cost double")
    found = sweep.cheapest(sweep.placed(table, cells), cells, starts, at_once)
    got = {(r["price"], r["source"], r["v"]): r["cost"] for r in found.collect()}
    want = {(p, s, v): c for p, s in runs for v, c in plain(arcs, s, p).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)

    trips = [(k, p, s, v) for k, (p, s, v) in enumerate((p, s, v) for p, s in runs for v in range(0, 60, 4))]
    paths = sweep.traces(found, spark.createDataFrame(trips, "trip_id long, price double, source long, target long")).collect()
    by_arc, by_trip = {a[0]: a for a in arcs}, {}
    for r in sorted(paths, key=lambda r: r["seq"]):
        by_trip.setdefault(r["trip_id"], []).append(by_arc[r["arc"]])
    for k, p, s, v in trips:
        path = by_trip.get(k, [])
        assert bool(path) == ((p, s, v) in want and v != s)
        if path:
            assert path[0][1] == s and path[-1][2] == v and all(x[2] == y[1] for x, y in zip(path, path[1:]))
            assert abs(sum(t + p * x for *_, t, x in path) - want[p, s, v]) < 1e-6  # a trace comes to its cost


@pytest.mark.parametrize("size,at_once", [(7, 2), (1000, 64)])
def test_totals_are_what_the_traces_come_to(spark, world, size, at_once, monkeypatch):
    monkeypatch.setattr(sweep, "ROUNDS_HELD", 3)
    arcs, vertices, table = world
    cells = sweep.cells(vertices, size)
    runs = [(p, s) for p in (0.0, 20.0) for s in (0, 17, 58)]
    found = cut(sweep.cheapest(sweep.placed(table, cells), cells, spark.createDataFrame([(p, s, s, 0.0) for p, s in runs], "price double, source long, v long, cost double"), at_once))
    assert found.count() == found.select("price", "source", "v").distinct().count()
    trips = found.select(F.monotonically_increasing_id().alias("trip_id"), "price", "source", F.col("v").alias("target"))
    by_run = sweep.traces(found, trips).join(table, "arc").groupBy("trip_id").agg(F.count("arc").alias("n"), F.sum("t").alias("T"), F.sum("x").alias("X")).join(trips, "trip_id")
    want = {(r["price"], r["source"], r["target"]): (r["n"], r["T"], r["X"]) for r in by_run.collect()}
    got = {(r["price"], r["source"], r["v"]): (r["n"], r["T"], r["X"]) for r in sweep.totals(found, table).collect()}
    assert {k for k, r in got.items() if r[0]} == want.keys() and len(got) == found.count() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert all(r == (0, 0.0, 0.0) for k, r in got.items() if k not in want)


def test_a_round_is_read_and_written_for_its_cells_alone(spark, monkeypatch):
    """A path of 12 cells: the rows that the rounds write grow with the cells, not with the cells times the rounds."""
    n, rows = 48, []
    table = spark.createDataFrame([(k, k, k + 1, 1.0, 0.0) for k in range(n - 1)], "arc long, a long, b long, t double, x double")
    cells = spark.range(n).select(F.col("id").alias("v"), F.expr("id div 4").alias("cell"))
    keep = sweep.cut
    monkeypatch.setattr(sweep, "cut", lambda df: rows.append((out := keep(df)).count()) or out)
    found = sweep.cheapest(sweep.placed(table, cells), cells, spark.createDataFrame([(0.0, 0, 0, 0.0)], "price double, source long, v long, cost double"))
    assert {r["v"]: r["cost"] for r in found.collect()} == {k: float(k) for k in range(n)}
    assert sum(rows) <= 2 * n


def test_several_ways_to_begin_and_none(spark, world):
    arcs, vertices, table = world
    cells = sweep.cells(vertices, 9)
    starts = spark.createDataFrame([(0.0, 1, 0, 100.0, 901), (0.0, 1, 17, 5.0, 902)], "price double, source long, v long, cost double, arc long")
    got = {r["v"]: (r["cost"], r["arc"], r["prev"]) for r in sweep.cheapest(sweep.placed(table, cells), cells, starts).collect()}
    a, b = plain(arcs, 0, 0.0), plain(arcs, 17, 0.0)
    assert {v: c[0] for v, c in got.items()} == {v: min(a.get(v, 1e18) + 100, b.get(v, 1e18) + 5) for v in a.keys() | b.keys()}
    assert got[17] == (5.0, 902, None)
    empty = sweep.cheapest(sweep.placed(table, cells), cells, starts.limit(0))
    assert empty.count() == 0 and sweep.traces(empty, spark.createDataFrame([(1, 0.0, 1, 2)], "trip_id long, price double, source long, target long")).count() == 0


def test_evaluation_of_paths(spark):
    paths = spark.createDataFrame([(1, 0.0, 0, 10), (1, 0.0, 1, 11), (1, 0.0, 2, 12)], "trip_id long, price double, seq long, arc long")
    edges = spark.createDataFrame([(10, 5.0, 50.0, 1.0, 350.0), (11, 6.0, 60.0, 0.5, 20.0), (12, 7.0, 70.0, 0.0, 110.0)], "edge_id long, t double, len double, x double, heading double")
    exposure = spark.createDataFrame([(10, 1), (11, 1), (11, 2)], "edge_id long, site long")
    r = sweep.evaluated(paths, edges, exposure).select("T", "L", "X", "D", F.col("turns")).first()
    assert tuple(r) == (18.0, 180.0, 1.5, 2, 1)
