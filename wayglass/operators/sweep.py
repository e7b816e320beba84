"""Cheapest paths from many sources at many prices over a graph of any size, and their traces.

The graph is cut into cells of neighbouring vertices (`cells`: at most `size` each, in the order of a space-filling curve). A round solves every cell
that something new came to, each in a task of its own: from the best costs known so far the cell is searched to its end, and what leaves it goes to its
neighbours as candidates of the next round. The rounds are those of the cells that a path crosses, not of its arcs, and no task holds more than a cell of the graph
and a bucket of runs. A run is a price and a source; costs are t + price * x. Each vertex keeps the arc that it is reached by, so that paths are
traced back cell by cell in the same way.

Of equally cheap ways the one that is found first stays. Vertices that can't be reached have no row. Parallel arcs and loops are allowed; t and x must not be negative.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayglass.plans.iterate import cut, numbered, scratch_path

EPS = 1e-9
STATE = "price double, source long, v long, cell long, bucket int, cost double, arc long, prev long, prev_cell long, fresh boolean"
FOLLOWED = "trip_id long, price double, source long, v long, cell long, bucket int, k long, arc long"
#: Bits of each coordinate in the order of cells.
BITS = 20


def cells(vertices: DataFrame, size: int = 16_384) -> DataFrame:
    """v, cell. vertices: v, x, y. Cells are runs of `size` vertices along a curve that visits neighbours one after the other."""
    box = vertices.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("w"))
    scaled = vertices.crossJoin(F.broadcast(box))  # one row
    at = [F.floor((F.col(c) - F.col(f"{c}0")) / F.col("w") * ((1 << BITS) - 1)).cast("long") for c in ("x", "y")]
    z = F.lit(0).cast("long")
    for bit in range(BITS):
        for side, c in enumerate(at):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1)), 2 * bit + side))
    rows = numbered(scaled.select("v", z.alias("z")), ["z", "v"])
    return rows.select("v", F.call_function("div", F.col("i"), F.lit(size)).cast("long").alias("cell"))


def placed(arcs: DataFrame, cells_: DataFrame) -> DataFrame:
    """arcs (arc, a, b, t, x) with the cells of their ends, written in the order of a_cell: a round that asks for some cells reads little else."""
    on = lambda end: cells_.select(F.col("v").alias(end), F.col("cell").alias(f"{end}_cell"))
    rows = arcs.select("arc", "a", "b", F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x")).join(on("a"), "a").join(on("b"), "b")
    path = f"{scratch_path(rows.sparkSession, 'arcs')}/t"
    rows.repartitionByRange("a_cell").sortWithinPartitions("a_cell").write.option("parquet.block.size", 1 << 22).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _whole(values: np.ndarray, missing: np.ndarray) -> pd.Series:
    return pd.Series(pd.arrays.IntegerArray(values, missing))


def _relax(key: tuple, arcs: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """A cell's runs one after the other; what is known of a run is kept in arrays."""
    cell, bucket = int(key[0]), int(key[1])
    a, b, to_cell = (arcs[c].to_numpy(np.int64) for c in ("a", "b", "b_cell"))
    own = np.unique(np.concatenate([a, b[to_cell == cell], state["v"].to_numpy(np.int64)]))
    beyond, first = np.unique(b[to_cell != cell], return_index=True)
    beyond_cell = to_cell[to_cell != cell][first]
    n, names = len(own), np.concatenate([own, beyond])
    cell_of = np.concatenate([np.full(n, cell, np.int64), beyond_cell])
    at = np.searchsorted(own, a)
    order = np.argsort(at, kind="stable")
    head = np.searchsorted(at[order], np.arange(n + 1)).tolist()
    ends = np.where(to_cell == cell, np.searchsorted(own, b), n + np.searchsorted(beyond, b))[order].tolist() if len(b) else []
    ts, xs = arcs["t"].to_numpy(float)[order].tolist(), arcs["x"].to_numpy(float)[order].tolist()
    arc_ids, starts_at = arcs["arc"].to_numpy(np.int64)[order], a[order]
    known = {c: (state[c].fillna(0).to_numpy(np.int64), state[c].isna().to_numpy()) for c in ("arc", "prev", "prev_cell")}
    places, costs, fresh = np.searchsorted(own, state["v"].to_numpy(np.int64)), state["cost"].to_numpy(float), state["fresh"].to_numpy(bool)
    out = []
    for (price, source), rows in state.groupby(["price", "source"], sort=True).indices.items():
        cost, came = [math.inf] * len(names), [-1] * len(names)  # came: an arc of this cell, or -2 - k for row k of the state
        new = set()
        # what is settled first, then candidates
        rows = rows[np.lexsort((np.where(known["arc"][1][rows], -1, known["arc"][0][rows]), costs[rows], fresh[rows]))]
        for k, v, c, is_new in zip(rows.tolist(), places[rows].tolist(), costs[rows].tolist(), fresh[rows].tolist(), strict=True):
            if came[v] == -1 or c < cost[v] - EPS:
                cost[v], came[v] = c, -2 - k
                if is_new:
                    new.add(v)
        heap = [(cost[v], v) for v in new]
        heapq.heapify(heap)
        while heap:
            now, v = heapq.heappop(heap)
            if now > cost[v]:
                continue
            for k in range(head[v], head[v + 1]):
                w, c = ends[k], now + ts[k] + price * xs[k]
                if c < cost[w] - EPS:
                    cost[w], came[w] = c, k
                    if w < n:
                        heapq.heappush(heap, (c, w))
        came = np.array(came, np.int64)
        got = np.flatnonzero(came != -1)
        came = came[got]
        by_arc, row = came >= 0, -2 - came
        k, row = np.where(by_arc, came, 0), np.where(by_arc, 0, row)
        inner = lambda c, values: (np.where(by_arc, values[k] if len(values) else 0, known[c][0][row]), ~by_arc & known[c][1][row])
        arc, prev = inner("arc", arc_ids), inner("prev", starts_at)
        prev_cell = (np.where(by_arc, cell, known["prev_cell"][0][row]), ~by_arc & known["prev_cell"][1][row])
        frame = {"price": price, "source": source, "v": names[got], "cell": cell_of[got], "bucket": bucket, "cost": np.array(cost)[got], "arc": _whole(*arc), "prev": _whole(*prev), "prev_cell": _whole(*prev_cell), "fresh": got >= n}
        out.append(pd.DataFrame(frame))
    return pd.concat(out, ignore_index=True)


#: Results of so many rounds at most are looked through; then those that still count are written together.
ROUNDS_HELD = 24


def cheapest(arcs: DataFrame, cells_: DataFrame, starts: DataFrame, runs_at_once: int = 16, most: int = 10_000) -> DataFrame:
    """STATE of every vertex that a run reaches: its cost, the arc that it is reached by and where from (null where the run starts).

    arcs: as placed() gives them. starts: price, source, v, cost and optionally arc; several rows of a run are several ways to begin.
    A round reads and writes the cells that something new came to; the driver knows which round solved a cell last, two numbers for each cell and bucket.
    """
    spark = arcs.sparkSession
    arc = F.col("arc").cast("long") if "arc" in starts.columns else F.lit(None).cast("long")
    begin = starts.select(F.col("price").cast("double").alias("price"), F.col("source").cast("long").alias("source"), F.col("v").cast("long").alias("v"), F.col("cost").cast("double").alias("cost"), arc.alias("arc"))
    buckets = -(-begin.select("price", "source").distinct().count() // runs_at_once) or 1
    none = F.lit(None).cast("long")
    last = cut(
        begin.join(cells_, "v").select(
            "price", "source", "v", "cell", F.pmod(F.xxhash64("price", "source"), F.lit(buckets)).cast("int").alias("bucket"), "cost", "arc", none.alias("prev"), none.alias("prev_cell"), F.lit(True).alias("fresh")
        )
    )
    begun, held, solved = last, {}, {}

    def keys(rows: list[tuple]) -> DataFrame:
        return F.broadcast(spark.sql("SELECT * FROM VALUES " + ", ".join(f"({c}L, {b}, {r})" for c, b, r in rows) + " AS t(cell, bucket, round)"))

    def settled(wanted: list[tuple]) -> DataFrame | None:
        """Rows of cells and buckets, each from the round that solved it last."""
        found = None
        for r in sorted({r for *_, r in wanted}):
            one = held[r].filter("not fresh").withColumn("round", F.lit(r))
            found = one if found is None else found.unionByName(one)
        return None if found is None else found.join(keys(wanted), ["cell", "bucket", "round"], "left_semi").select(last.columns)

    for k in range(most):
        touched = [(r["cell"], r["bucket"]) for r in last.filter("fresh").select("cell", "bucket").distinct().collect()]  # cells, not vertices
        if not touched:
            break
        here = keys([(*c, k) for c in touched]).drop("round")
        cells_now = sorted({c for c, _ in touched})
        near = arcs.filter(F.col("a_cell").isin(cells_now)) if len(cells_now) <= 200 else arcs
        own = near.join(here.withColumnRenamed("cell", "a_cell"), "a_cell").select(F.col("a_cell").alias("cell"), "bucket", "a", "b", "b_cell", "arc", "t", "x")
        work, before = last.filter("fresh"), settled([(*c, solved[c]) for c in touched if c in solved])
        work = work if before is None else work.unionByName(before)
        last = held[k] = cut(own.groupBy("cell", "bucket").cogroup(work.groupBy("cell", "bucket")).applyInPandas(_relax, STATE))
        solved |= dict.fromkeys(touched, k)
        if len(held) > ROUNDS_HELD:
            others = [(*c, r) for c, r in solved.items() if r < k]
            held = {k: last} | ({} if not others else {-1: cut(settled(others))})
            solved = {c: k if r == k else -1 for c, r in solved.items()}
    else:
        raise RuntimeError(f"paths still get cheaper after {most} rounds")
    found = settled([(*c, r) for c, r in solved.items()])
    return (begun if found is None else found).drop("fresh")


def _totals(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What the paths of a run come to within a cell: each vertex looks through twice as many arcs in each round."""
    cell = int(key[0])
    v, prev = rows["v"].to_numpy(np.int64), rows["prev"].fillna(0).to_numpy(np.int64)
    root, within = rows["prev"].isna().to_numpy(), (rows["prev_cell"].fillna(-1).to_numpy(np.int64) == cell) & rows["prev"].notna().to_numpy()
    order = np.argsort(v)
    up = np.where(within, order[np.searchsorted(v, prev, sorter=order).clip(0, len(v) - 1)], np.arange(len(v)))
    n, t, x = rows["arc"].notna().to_numpy().astype(np.int64), rows["t"].fillna(0.0).to_numpy(float), rows["x"].fillna(0.0).to_numpy(float)
    # the sums of a vertex are those up to `up`, which isn't counted; a vertex that is its own `up` is where the path came into the cell
    top = ~within
    own = [np.where(top, 0, c) for c in (n, t, x)]
    while not top[up].all():
        own = [c + c[up] for c in own]
        up = up[up]
    n, t, x = (c + first[up] for c, first in zip(own, (n, t, x), strict=True))
    return pd.DataFrame({"price": rows["price"], "source": rows["source"], "v": v, "n": n, "T": t, "X": x, "on": _whole(prev[up], root[up]), "on_cell": _whole(rows["prev_cell"].fillna(0).to_numpy(np.int64)[up], root[up])})


def totals(state: DataFrame, values: DataFrame) -> DataFrame:
    """price, source, v, n, T, X: the number of arcs on the path to each vertex, and what their t and x add up to, along the arcs that the paths took.

    state: what cheapest() gives. values: arc, t, x. A path isn't taken apart for each of its ends: its sums within a cell come from the run's rows of that cell, and where paths cross from
    cell to cell the sums are put together by pointer jumping, in as many rounds as the logarithm of the cells of a path.
    """
    kind = "price double, source long, v long, n long, T double, X double, on long, on_cell long"
    rows = state.join(values.select("arc", F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x")), "arc", "left")
    parts = cut(rows.select("cell", "price", "source", "v", "arc", "prev", "prev_cell", "t", "x").groupBy("cell", "price", "source").applyInPandas(_totals, kind))
    run = ["price", "source"]
    asked = parts.filter("on is not null").select(*run, F.col("on").alias("v")).distinct()
    at = cut(parts.join(asked, [*run, "v"], "left_semi").select(*run, "v", "n", "T", "X", "on"))
    while not at.filter("on is not null").isEmpty():
        further = at.select(*run, F.col("v").alias("on"), F.col("n").alias("n2"), F.col("T").alias("T2"), F.col("X").alias("X2"), F.col("on").alias("on2"))
        plus = lambda c: (F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c)
        at = cut(at.join(further, [*run, "on"], "left").select(*run, "v", plus("n"), plus("T"), plus("X"), F.col("on2").alias("on")))
    ends = at.select(*run, F.col("v").alias("on"), F.col("n").alias("n2"), F.col("T").alias("T2"), F.col("X").alias("X2"))
    return parts.join(ends, [*run, "on"], "left").select(*run, "v", *[(F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c) for c in ("n", "T", "X")])


def _follow(key: tuple, state: pd.DataFrame, walkers: pd.DataFrame) -> pd.DataFrame:
    cell, bucket = int(key[0]), int(key[1])
    state = state.astype({"arc": "Int64", "prev": "Int64", "prev_cell": "Int64"}).astype(object).where(lambda d: d.notna(), None)
    came = {(p, s, v): (arc, prev, prev_cell) for p, s, v, arc, prev, prev_cell in zip(*(state[c].tolist() for c in ("price", "source", "v", "arc", "prev", "prev_cell")), strict=True)}
    out = []
    for trip, price, source, v, k in zip(*(walkers[c].tolist() for c in ("trip_id", "price", "source", "v", "k")), strict=True):
        at = cell
        while at == cell and v is not None:
            arc, prev, at = came[price, source, v]
            if arc is not None:
                out.append((trip, price, source, None, cell, bucket, k, arc))
                k += 1
            v = prev
        if v is not None:
            out.append((trip, price, source, v, at, bucket, k, None))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in FOLLOWED.split(", ")])
    return frame.astype({"v": "Int64", "arc": "Int64"})


def traces(state: DataFrame, trips: DataFrame, most: int = 10_000) -> DataFrame:
    """trip_id, price, seq (from 0), arc: the path of each trip (trip_id, price, source, target) that has one; a trip that begins at its target has no arcs.

    state: what cheapest() gives.
    """
    state = cut(state)
    asked = trips.select("trip_id", F.col("price").cast("double").alias("price"), F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("v"))
    walkers = cut(asked.join(state.select("price", "source", "v", "cell", "bucket"), ["price", "source", "v"]).select("trip_id", "price", "source", "v", "cell", "bucket", F.lit(0).cast("long").alias("k")))
    steps = []
    for _ in range(most):
        if not walkers.limit(1).count():
            break
        here = state.join(walkers.select("cell", "bucket").distinct(), ["cell", "bucket"], "left_semi").select(state.columns)
        those = walkers.select(*[F.col(c).alias(f"w_{c}") for c in walkers.columns]).toDF(*walkers.columns)
        moved = cut(here.groupBy("cell", "bucket").cogroup(those.groupBy("cell", "bucket")).applyInPandas(_follow, FOLLOWED))
        steps.append(moved.filter("arc is not null").select("trip_id", "price", "k", "arc"))
        walkers = moved.filter("arc is null").drop("arc")
    else:
        raise RuntimeError(f"paths go on after {most} rounds")
    found = steps[0] if steps else walkers.select("trip_id", "price", "k", F.lit(0).cast("long").alias("arc"))
    for more in steps[1:]:
        found = found.unionByName(more)
    found = cut(found)
    length = found.groupBy("trip_id", "price").agg((F.max("k") + 1).alias("n"))
    return found.join(length, ["trip_id", "price"]).select("trip_id", "price", (F.col("n") - 1 - F.col("k")).alias("seq"), "arc")


def evaluated(paths: DataFrame, edges: DataFrame, exposure: DataFrame, turn_deg: float = 45.0) -> DataFrame:
    """trip_id, price, T (s), L (m), X (units of exposure), D (distinct sites), turns: what each traced path comes to. edges: edge_id, t, len, x, heading. exposure: edge_id, site."""
    on = paths.withColumnRenamed("arc", "edge_id").join(edges, "edge_id")
    w = Window.partitionBy("trip_id", "price").orderBy("seq")
    change = F.abs(F.col("heading") - F.lag("heading").over(w))
    turns = on.withColumn("turned", F.coalesce(F.least(change, 360 - change) > turn_deg, F.lit(False)).cast("long"))
    sums = turns.groupBy("trip_id", "price").agg(F.sum("t").alias("T"), F.sum("len").alias("L"), F.sum("x").alias("X"), F.sum("turned").alias("turns"))
    sites = on.select("trip_id", "price", "edge_id").join(exposure.select("edge_id", "site"), "edge_id").groupBy("trip_id", "price").agg(F.countDistinct("site").alias("D"))
    return sums.join(sites, ["trip_id", "price"], "left").fillna(0, ["D"])
