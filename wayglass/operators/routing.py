"""Batch routing: requests (a trip at a price) are spread over tasks, each of which searches one region's graph with A* on edges.

What takes several searches (a time budget, options to choose from) goes in rounds: one job solves all trips, each at the price that its own
earlier results ask for. Frontiers, budgets and choices between results are relational.

A small region's graph is broadcast; what is collected is counted first. A region of over `MOST_SENT` edges, whose edges have positions, stays where it is: its edges and moves lie in tiles, and each
trip is searched in a window of tiles around it, in a task of its own. A search that would go on beyond its window before it is done says so and is repeated in a wider one, so that results are those of the whole
graph. Only a single search that can't be settled within `MAX_EDGES` edges is an error. Larger regions without positions, or with exposure on parts of edges, have to be split (or solved by graph.relaxed_costs).
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.plans.iterate import cut, scratch_path

MAX_EDGES, MAX_MOVES = 1_000_000, 4_000_000
#: Edges of a region with positions that is still sent to all tasks; edges of a tile, as a mean, and by how many tiles a window reaches beyond its trip at first, and how much further each time.
MOST_SENT, TILE_EDGES, MARGIN, WIDER = 250_000, 1_000, 1, 4
#: Prices of the sweep and of the budget, how often each is bisected, and the limits of what is offered.
SWEEP = (10.0, 30.0, 60.0, 120.0, 300.0, 900.0, 3000.0)
BUDGET_MAX, BUDGET_PROBES, SWEEP_PROBES, CLOSE = 1800.0, 7, 4, 1.1
MAX_EXTRA, RECOMMENDED_EXTRA, MAX_OPTIONS = 0.5, 0.1, 4
#: Metres within which a place on a road is its end, degrees of a turn.
AT_NODE_M, TURN_DEG = 0.5, 45.0
EPS = 1e-9


@dataclass
class Found:
    cost: float = math.inf
    time_s: float = 0.0
    length_m: float = 0.0
    turns: int = 0
    score: float = 0.0
    edges: list[int] = field(default_factory=list)
    #: Metres into the first edge at which the path starts, and into the last one at which it ends.
    start_m: float = 0.0
    end_m: float = 0.0
    #: The search came to where its window ends: nothing is known yet.
    beyond: bool = False


@dataclass(frozen=True)
class Place:
    """A node, or a point on a road some metres from the start of its geometry."""

    node: int | None = None
    geom: int | None = None
    at_m: float = 0.0


@dataclass(frozen=True)
class Step:
    """How an edge is come to: from which edge (-1: the path starts on it, `start` metres in), turn time, weight met on it, change of heading."""

    before: int
    turn_s: float = 0.0
    weight: float = 0.0
    turn: float = 0.0
    start: float = 0.0


class Graph:
    """Edges, moves between them, and the weight of new sites of each move; costs are to the end of an edge.

    edges: edge_id, src, dst, time_s, len, and for points within roads geom_id, rev, for straight-line bounds x, y (of dst). moves: e, f, turn_s, turn, w.
    exposure: edge_id, site, entry_m, exit_m, at_end, weight, for what is met on a part of an edge.
    """

    def __init__(self, edges: pd.DataFrame, moves: pd.DataFrame, starts: pd.DataFrame | None = None, exposure: pd.DataFrame | None = None):
        self.of = {e: i for i, e in enumerate(edges["edge_id"].tolist())}
        self.ids = edges["edge_id"].tolist()
        self.src, self.dst = edges["src"].tolist(), edges["dst"].tolist()
        self.time, self.length = edges["time_s"].tolist(), edges["len"].tolist()
        self.rev = edges["rev"].tolist() if "rev" in edges else [False] * len(self.ids)
        self.pos = dict(zip(self.dst, zip(edges["x"].tolist(), edges["y"].tolist(), strict=True), strict=True)) if "x" in edges else {}
        self.fastest = max((le / t for le, t in zip(self.length, self.time, strict=True) if t > 0), default=1.0)
        self.out: dict[int, list[int]] = {}
        for i, s in enumerate(self.src):
            self.out.setdefault(s, []).append(i)
        self.on: dict[int, list[int]] = {}
        for i, g in enumerate(edges["geom_id"].tolist() if "geom_id" in edges else ()):
            self.on.setdefault(g, []).append(i)
        self.next: list[list[tuple[int, float, float, float]]] = [[] for _ in self.ids]
        turns = moves["turn"].tolist() if "turn" in moves else [0.0] * len(moves)
        weights = moves["w"].tolist() if "w" in moves else [0.0] * len(moves)
        for e, f, s, w, t in zip(moves["e"].tolist(), moves["f"].tolist(), moves["turn_s"].tolist(), weights, turns, strict=True):
            self.next[self.of[e]].append((self.of[f], s, w, t))
        self.first: dict[int, float] = {} if starts is None else {self.of[e]: w for e, w in zip(starts["edge_id"].tolist(), starts["w"].tolist(), strict=True)}
        #: Edges of a window that can't be searched on from, or back from, within it.
        self.rim: set[int] = set()
        self.rim_back: set[int] = set()
        self.seen: dict[int, list[tuple]] = {}
        for e, *row in () if exposure is None else exposure[["edge_id", "site", "entry_m", "exit_m", "at_end", "weight"]].itertuples(index=False, name=None):
            if e in self.of:
                self.seen.setdefault(self.of[e], []).append(tuple(row))

    def met(self, e: int, a: float, b: float) -> float:
        """Weight of the sites that see edge e anywhere from a to b metres."""
        return sum(w for _, entry, leave, _, w in self.seen.get(e, ()) if entry <= b and leave >= a)

    def newly_met(self, e: int, f: int, b: float) -> float:
        """Weight of the sites that see f up to b metres, without those that hold the vehicle as e ends."""
        held = {site for site, _, _, at_end, _ in self.seen.get(e, ()) if at_end}
        return sum(w for site, entry, _, _, w in self.seen.get(f, ()) if entry <= b and site not in held)

    def place(self, p: int | Place) -> Place:
        """Points at the end of a road are its nodes."""
        if not isinstance(p, Place):
            return Place(node=p)
        if p.node is not None:
            return p
        e = self.on[p.geom][0]
        ends = (self.dst[e], self.src[e]) if self.rev[e] else (self.src[e], self.dst[e])
        if p.at_m <= AT_NODE_M:
            return Place(node=ends[0])
        return Place(node=ends[1]) if p.at_m >= self.length[e] - AT_NODE_M else p

    def _along(self, p: Place) -> dict[int, float]:
        """Metres of a point on each edge of its road."""
        return {e: self.length[e] - p.at_m if self.rev[e] else p.at_m for e in self.on[p.geom]}

    def _goals(self, p: Place | None) -> list[tuple[float, float]]:
        """Points of which a path to p passes one; none if one isn't known."""
        if p is None:
            return []
        nodes = [p.node] if p.node is not None else [n for e in self.on[p.geom] for n in (self.src[e], self.dst[e])]
        return [self.pos[n] for n in nodes] if all(n in self.pos for n in nodes) else []

    def _rest(self, edge: int, goals: list[tuple[float, float]]) -> float:
        """Admissible: straight line at the fastest speed of the graph."""
        at = self.pos.get(self.dst[edge]) if goals else None
        return min(math.dist(at, g) for g in goals) / self.fastest if at else 0.0

    def search(self, source: int | Place, target: int | Place | None, price: float = 0.0, straight: bool = True) -> dict[int, float] | Found:
        """Costs to the end of every edge (no target), or the best path between two nodes or points. straight=False: Dijkstra."""
        a, b = self.place(source), None if target is None else self.place(target)
        if b is not None and a.node is not None and a.node == b.node:
            return Found(cost=0.0)
        goals = self._goals(b) if straight else []
        ends = self._along(b) if b is not None and b.node is None else {}
        best: dict[int, float] = {}
        came: dict[int, Step] = {}
        heap: list[tuple] = []

        def offer(e: int, cost: float, step: Step) -> None:
            if cost < best.get(e, math.inf):
                best[e], came[e] = cost, step
                heapq.heappush(heap, (cost + self._rest(e, goals), cost, e, ()))

        def arrive(e: int, cost: float, step: Step) -> None:
            # an arrival on the way along an edge is a state of its own: the first that is taken out is the best
            heapq.heappush(heap, (cost, cost, e, (step,)))

        begun = {e: 0.0 for e in self.out.get(a.node, ())} if a.node is not None else self._along(a)
        for e, at in begun.items():
            per_m = self.time[e] / self.length[e] if self.length[e] else 0.0
            w = self.met(e, at, math.inf) if at else self.first.get(e, 0.0)
            offer(e, self.time[e] - at * per_m + price * w, Step(-1, weight=w, start=at))
            if ends.get(e, -1.0) >= at:
                w = self.met(e, at, ends[e])
                arrive(e, (ends[e] - at) * per_m + price * w, Step(-1, weight=w, start=at))
        while heap:
            _, cost, e, arrived = heapq.heappop(heap)
            if arrived:
                return self._path(e, cost, came, ends[e], arrived[0])
            if cost > best[e]:
                continue
            if b is not None and self.dst[e] == b.node:
                return self._path(e, cost, came, self.length[e], came[e])
            if e in self.rim:
                return Found(beyond=True)
            for f, turn_s, w, turn in self.next[e]:
                if f in ends:
                    part = self.newly_met(e, f, ends[f])
                    arrive(f, cost + turn_s + self.time[f] * ends[f] / self.length[f] + price * part, Step(e, turn_s, part, turn))
                offer(f, cost + turn_s + self.time[f] + price * w, Step(e, turn_s, w, turn))
        return {self.ids[e]: c for e, c in best.items()} if target is None else Found()

    def cut_off(self, source: int | Place, target: int | Place) -> bool:
        """Is it certain, within the window, that no way leads from source to target? Searched back from the target."""
        a, b = self.place(source), self.place(target)
        stack = [e for e, n in enumerate(self.dst) if n == b.node] if b.node is not None else list(self._along(b))
        begun = set(self.out.get(a.node, ()) if a.node is not None else self._along(a))
        before: dict[int, list[int]] = {}
        for e, ways in enumerate(self.next):
            for f, *_ in ways:
                before.setdefault(f, []).append(e)
        seen = set(stack)
        while stack:
            f = stack.pop()
            if f in begun or f in self.rim_back:
                return False
            for e in before.get(f, ()):
                if e not in seen:
                    seen.add(e)
                    stack.append(e)
        return True

    def _path(self, e: int, cost: float, came: dict[int, Step], end: float, last: Step) -> Found:
        out, step, stop = Found(cost=cost, end_m=end), last, end
        while True:
            driven = stop - step.start
            out.edges.append(self.ids[e])
            out.time_s += step.turn_s + (self.time[e] * driven / self.length[e] if self.length[e] else self.time[e])
            out.length_m += driven
            out.score += step.weight
            out.turns += abs(step.turn) > TURN_DEG
            if step.before < 0:
                out.start_m = step.start
                out.edges.reverse()
                return out
            e = step.before
            step, stop = came[e], self.length[e]


class Region:
    """A region's graph. A small one is sent to the tasks once; they keep it for the rounds that follow. One of over MOST_SENT edges lies in tiles. Refuses more than the limits before it collects any."""

    def __init__(self, edges: DataFrame, moves: DataFrame, starts: DataFrame | None = None, exposure: DataFrame | None = None):
        edges, moves, starts, exposure = (None if df is None else cut(df) for df in (edges, moves, starts, exposure))
        n = edges.count()
        self.tiles = None
        if n > MOST_SENT and exposure is None and {"x", "y"} <= set(edges.columns):
            self._place(edges, moves, starts, n)
            return
        for df, most, what in ((edges, MAX_EDGES, "edges"), (moves, MAX_MOVES, "moves"), (exposure, MAX_MOVES, "exposures")):
            n = df.count() if df is not None else 0
            if n > most:
                raise ValueError(f"{n} {what}: split the region, at most {most} are sent to each executor")
        parts = tuple(None if df is None else df.toPandas() for df in (edges, moves, starts, exposure))
        self.parts, self.name = edges.sparkSession.sparkContext.broadcast(parts), uuid.uuid4().hex

    def _place(self, edges: DataFrame, moves: DataFrame, starts: DataFrame | None, n: int) -> None:
        """Edges lie in the tiles of both their ends, moves in that of the node where they turn: a tile has all that leads out of its nodes."""
        box = edges.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.max(F.when(F.col("time_s") > 0, F.col("len") / F.col("time_s")))).first()
        wide, high = max(box[2] - box[0], 1.0), max(box[3] - box[1], 1.0)
        side = max(math.sqrt(wide * high * TILE_EDGES / n), wide / (1 << 20), high / (1 << 20))
        self.fastest, self.columns, self.rows = box[4] or 1.0, int(wide // side) + 1, int(high // side) + 1
        at = lambda x, y: (F.floor((F.col(x) - box[0]) / side).cast("long").alias("tx"), F.floor((F.col(y) - box[1]) / side).cast("long").alias("ty"))
        ends = cut(edges.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct(*at("x", "y"))).alias("tile")))
        none = lambda kind: F.lit(None).cast(kind)
        e = edges if starts is None else edges.join(starts.select("edge_id", F.col("w").alias("w0")), "edge_id", "left")
        e = e.withColumn("w0", F.coalesce("w0", F.lit(0.0)) if starts is not None else F.lit(0.0)).join(ends.select(F.col("node").alias("src"), F.col("tile").alias("from")), "src", "left")
        e = e.withColumn("to", F.struct(*at("x", "y"))).withColumn("from", F.coalesce("from", F.min("to").over(Window.partitionBy("src"))))
        self.ends = cut(e.select(F.col("src").alias("node"), F.col("from").alias("tile")).unionByName(e.select(F.col("dst").alias("node"), F.col("to").alias("tile"))).groupBy("node").agg(F.min("tile").alias("tile")))
        self.geoms = cut(e.groupBy("geom_id").agg(F.min("to").alias("tile"))) if "geom_id" in edges.columns else None
        named = lambda c, kind: F.col(c).cast(kind) if c in edges.columns else none(kind)
        kept = e.withColumn("tile", F.explode(F.array_distinct(F.array("from", "to")))).select(
            "tile", F.lit(True).alias("is_edge"), F.col("edge_id").alias("a"), F.col("src").alias("b"), F.col("dst").alias("c"), F.col("time_s").alias("p"), F.col("len").alias("q"), "x", "y", "w0", named("geom_id", "long").alias("geom"), named("rev", "boolean").alias("rev"), "from", "to"
        )
        said = lambda c: F.col(c).cast("double") if c in moves.columns else F.lit(0.0)
        turned = moves.join(e.select(F.col("edge_id").alias("e"), F.col("to").alias("tile")), "e").select(
            "tile", F.lit(False).alias("is_edge"), F.col("e").alias("a"), F.col("f").alias("b"), none("long").alias("c"), F.col("turn_s").alias("p"), said("turn").alias("q"), said("w").alias("x"), none("double").alias("y"), none("double").alias("w0"),
            none("long").alias("geom"), none("boolean").alias("rev"), none("struct<tx:long,ty:long>").alias("from"), none("struct<tx:long,ty:long>").alias("to"),
        )
        flat = kept.unionByName(turned).select("tile.tx", "tile.ty", *"is_edge a b c p q x y w0 geom rev".split(), F.col("from.tx").alias("fx"), F.col("from.ty").alias("fy"), F.col("to.tx").alias("gx"), F.col("to.ty").alias("gy"))
        path = f"{scratch_path(edges.sparkSession, 'tiles')}/t"
        flat.repartitionByRange("ty", "tx").sortWithinPartitions("ty", "tx").write.parquet(path)
        self.tiles = edges.sparkSession.read.schema(flat.schema).parquet(path)


_graphs: dict[str, Graph] = {}


def _graph(name: str, parts) -> Graph:
    """The graph in a worker's memory; another region takes its place."""
    if name not in _graphs:
        _graphs.clear()
        _graphs[name] = Graph(*parts.value)
    return _graphs[name]


PATHS = "trip_id long, price double, cost double, time_s double, length_m double, turns int, score double, edges array<long>, start_m double, end_m double"
_PLACES = ("src_geom", "src_m", "dst_geom", "dst_m")


def _end(node, geom, at) -> Place:
    return Place(node=int(node)) if pd.notna(node) else Place(geom=int(geom), at_m=float(at))


def _searched(graph: Graph, asked: pd.DataFrame) -> Iterator[tuple]:
    """PATHS and whether the search has to be repeated in a wider window."""
    for trip, price, src, dst, *at in zip(*[asked[c].tolist() for c in ("trip_id", "price", "src", "dst", *_PLACES)], strict=True):
        source, target = _end(src, at[0], at[1]), _end(dst, at[2], at[3])
        r = graph.search(source, target, price)
        there = r.cost < math.inf
        yield trip, price, r.cost if there else None, r.time_s if there else None, r.length_m, int(r.turns), r.score, r.edges, r.start_m, r.end_m, r.beyond and not graph.cut_off(source, target)


def solve(requests: DataFrame, region: Region) -> DataFrame:
    """PATHS of requests (trip_id, price, src, dst), all in one job if the region is small. Where src or dst is null, src_geom and src_m (dst_geom, dst_m) give a point on a road. No time: not to be reached."""
    missing = {c: F.lit(None).cast("double") for c in _PLACES if c not in requests.columns}
    asked = requests.withColumns(missing).select("trip_id", F.col("price").cast("double").alias("price"), "src", "dst", *_PLACES)
    if region.tiles is not None:
        return _solve_in_windows(asked, region)
    name, parts = region.name, region.parts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r[:-1] for r in _searched(_graph(name, parts), b)], columns=[c.split()[0] for c in PATHS.split(", ")])

    return asked.mapInPandas(run, PATHS)


def _window_solver(fastest: float):
    """A task's work: the graph of one window, and the requests that lie in it."""
    names = [*[c.split()[0] for c in PATHS.split(", ")], "beyond"]

    def run(key: tuple, tiles: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        x0, y0, x1, y1 = (int(asked[c].iloc[0]) for c in ("x0", "y0", "x1", "y1"))
        is_edge = tiles["is_edge"].astype(bool)
        edges = tiles[is_edge].drop_duplicates("a")
        if len(edges) > MAX_EDGES:
            raise ValueError(f"trip {key[0]}: {len(edges)} edges around it don't settle it, split the region; at most {MAX_EDGES} are searched in one task")
        table = pd.DataFrame({"edge_id": edges["a"], "src": edges["b"], "dst": edges["c"], "time_s": edges["p"], "len": edges["q"], "x": edges["x"], "y": edges["y"]})
        if edges["rev"].notna().any():
            table["rev"] = edges["rev"].astype(bool)
        if edges["geom"].notna().any():
            table["geom_id"] = edges["geom"].astype("int64")
        turned = tiles[~is_edge]
        graph = Graph(table.astype({c: "int64" for c in ("edge_id", "src", "dst")}), pd.DataFrame({"e": turned["a"], "f": turned["b"], "turn_s": turned["p"], "turn": turned["q"], "w": turned["x"]}), pd.DataFrame({"edge_id": edges["a"], "w": edges["w0"]}))
        graph.fastest = fastest
        inside = lambda x, y: ((edges[x] >= x0) & (edges[x] <= x1) & (edges[y] >= y0) & (edges[y] <= y1)).tolist()
        graph.rim = {i for i, held in enumerate(inside("gx", "gy")) if not held}
        graph.rim_back = {i for i, held in enumerate(inside("fx", "fy")) if not held}
        return pd.DataFrame(list(_searched(graph, asked)), columns=names)

    return run


def _solve_in_windows(asked: DataFrame, region: Region) -> DataFrame:
    """Each trip in a window of tiles around its ends; those that come to its rim again, in a wider one, until none is left."""
    asked = asked.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")})
    run = _window_solver(region.fastest)
    placed = asked
    for side in ("src", "dst"):
        placed = placed.join(region.ends.select(F.col("node").alias(side), F.col("tile").alias(f"_{side}")), side, "left")
        if region.geoms is not None:
            placed = placed.join(region.geoms.select(F.col("geom_id").cast("double").alias(f"{side}_geom"), F.col("tile").alias(f"_{side}_g")), f"{side}_geom", "left").withColumn(f"_{side}", F.coalesce(f"_{side}", f"_{side}_g")).drop(f"_{side}_g")
    ends = [F.coalesce("_src", "_dst"), F.coalesce("_dst", "_src")]
    reach = [(name, F.coalesce(f(*[e[c] for e in ends]), F.lit(0).cast("long"))) for name, f, c in (("x0", F.least, "tx"), ("y0", F.least, "ty"), ("x1", F.greatest, "tx"), ("y1", F.greatest, "ty"))]
    box = placed.withColumns(dict(reach)).drop("_src", "_dst").withColumn("beyond", F.lit(True))
    left, found, margin = cut(box), [], MARGIN
    while True:
        by_trip = left.groupBy("trip_id").agg(*[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
        low = lambda c: F.greatest(F.col(c) - margin, F.lit(0)).alias(c)
        windows = cut(by_trip.select("trip_id", low("x0"), low("y0"), F.least(F.col("x1") + margin, F.lit(region.columns - 1)).alias("x1"), F.least(F.col("y1") + margin, F.lit(region.rows - 1)).alias("y1")))
        held = windows.select("trip_id", F.explode(F.sequence("x0", "x1")).alias("tx"), "y0", "y1").select("trip_id", "tx", F.explode(F.sequence("y0", "y1")).alias("ty"))
        those = region.tiles.join(held, ["tx", "ty"])
        mine = left.drop("x0", "y0", "x1", "y1").join(windows, "trip_id")
        tried = cut(those.groupBy("trip_id").cogroup(mine.groupBy("trip_id")).applyInPandas(run, PATHS + ", beyond boolean"))
        found.append(tried.filter("not beyond").drop("beyond"))
        again = tried.filter("beyond").select("trip_id", "price")
        if again.isEmpty():
            return _all(found[0], found[1:])
        left, margin = cut(left.join(again, ["trip_id", "price"], "left_semi")), margin * WIDER


def at_prices(trips: DataFrame, price: Column) -> DataFrame:
    return trips.select("trip_id", *[c for c in ("src", "dst", *_PLACES) if c in trips.columns], price.alias("price"))


def bisected(trips: DataFrame, region: Region, limits: DataFrame, rounds: int, close: float = 1.0) -> list[DataFrame]:
    """What a search for the highest price that keeps within a limit of time finds, round by round, each trip halving its own bracket of prices.

    limits: trip_id, lo, hi, within_s, least (a score at which the trip is done).
    """
    state, found = cut(limits), []
    for _ in range(rounds):
        open_ = state.filter(F.col("hi") > F.col("lo") * close)
        if open_.isEmpty():
            break
        asked = trips.join(open_.select("trip_id", F.sqrt(F.col("lo") * F.col("hi")).alias("_p")), "trip_id")
        tried = cut(solve(at_prices(asked, F.col("_p")), region))
        found.append(tried)
        result = tried.select("trip_id", F.col("price").alias("_p"), F.col("time_s").alias("_t"), F.col("score").alias("_s"))
        fits = F.col("_t") <= F.col("within_s")
        moved = open_.join(result, "trip_id").select(
            "trip_id", F.when(fits, F.col("_p")).otherwise(F.col("lo")).alias("lo"), F.when(fits & (F.col("_s") <= F.col("least")), F.lit(None)).when(fits, F.col("hi")).otherwise(F.col("_p")).alias("hi"), "within_s", "least"
        )
        state = cut(moved)
    return found


def _all(first: DataFrame, more: list[DataFrame]) -> DataFrame:
    for df in more:
        first = first.unionByName(df)
    return first


def within_budget(trips: DataFrame, region: Region, extra: float) -> DataFrame:
    """PATHS: of each trip the path with the lowest score within (1 + extra) of the fastest time, the fastest among equals."""
    fast = cut(solve(at_prices(trips, F.lit(0.0)), region))
    limit = fast.select("trip_id", (F.col("time_s") * (1 + extra) + EPS).alias("within_s"), "score").filter("score > 0")
    dear = cut(solve(at_prices(trips.join(limit.select("trip_id"), "trip_id"), F.lit(BUDGET_MAX)), region))
    over = dear.select("trip_id", "time_s").join(limit, "trip_id").filter("time_s > within_s")
    probes = bisected(trips, region, over.select("trip_id", F.lit(1.0).alias("lo"), F.lit(BUDGET_MAX).alias("hi"), "within_s", F.lit(0.0).alias("least")), BUDGET_PROBES)
    pool = _all(dear, probes).join(limit.select("trip_id", "within_s"), "trip_id").filter("time_s <= within_s").drop("within_s")
    return fast.unionByName(pool).groupBy("trip_id").agg(F.min_by(F.struct(*[c.split()[0] for c in PATHS.split(", ")]), F.struct("score", "time_s", "price")).alias("r")).select("r.*")


def frontier(paths: DataFrame, trip: str = "trip_id") -> DataFrame:
    """The rows of each trip (time_s, score, price) that no faster one beats or equals in score."""
    w = Window.partitionBy(trip).orderBy("time_s", "score", "price").rowsBetween(Window.unboundedPreceding, -1)
    return paths.withColumn("_low", F.min("score").over(w)).filter(F.col("_low").isNull() | (F.col("score") < F.col("_low") - EPS)).drop("_low")


def spread(points: DataFrame, trip: str, order: list[str], most: int = MAX_OPTIONS, must: Column | None = None) -> DataFrame:
    """At most `most` of each trip's points (time_s, score) that lie far apart: the first, the last and `must`, then always the one farthest from those taken."""
    w = Window.partitionBy(trip)
    ends = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scaled = lambda c: (F.col(c) - F.first(c).over(ends)) / F.coalesce(F.nullif(F.last(c).over(ends) - F.first(c).over(ends), F.lit(0.0)), F.lit(1.0))
    table = points.withColumns({"_i": F.row_number().over(w.orderBy(*order)), "_n": F.count(F.lit(1)).over(w), "_x": scaled("time_s"), "_y": scaled("score")})
    kept = (F.col("_i") == 1) | (F.col("_i") == F.col("_n")) | (F.col("_n") <= most)
    table = cut(table.withColumn("_in", kept if must is None else kept | must))
    for _ in range(most - 2):
        taken = table.filter("_in").select(trip, F.col("_x").alias("_tx"), F.col("_y").alias("_ty"))
        far = table.filter("not _in").join(taken, trip).groupBy(trip, "_i").agg(F.round(F.min(F.hypot(F.col("_x") - F.col("_tx"), F.col("_y") - F.col("_ty"))), 9).alias("_d"), F.count(F.lit(1)).alias("_k"))
        chosen = far.filter(F.col("_k") < most).groupBy(trip).agg(F.max_by("_i", F.struct("_d", (-F.col("_i")).alias("o"))).alias("_add"))
        table = cut(table.join(chosen, trip, "left").withColumn("_in", F.col("_in") | F.coalesce(F.col("_i") == F.col("_add"), F.lit(False))).drop("_add"))
    return table.filter("_in").drop("_i", "_n", "_x", "_y", "_in")


def alternatives(trips: DataFrame, region: Region, most_extra: float = MAX_EXTRA, near_extra: float = RECOMMENDED_EXTRA) -> DataFrame:
    """PATHS with option and recommended: what is offered of each trip, from the frontier of time and score."""
    fast = cut(solve(at_prices(trips, F.lit(0.0)), region))
    limits = fast.select("trip_id", (F.col("time_s") * (1 + near_extra) + EPS).alias("near_s"), (F.col("time_s") * (1 + most_extra) + EPS).alias("most_s"), "score")
    seen = limits.filter("score > 0")
    swept = solve(at_prices(trips.join(seen.select("trip_id"), "trip_id").withColumn("_p", F.explode(F.array(*map(F.lit, SWEEP)))), F.col("_p")), region)
    # a trip's sweep ends with the first price at which it takes too long or meets nothing
    over = (F.col("time_s") > F.col("most_s")) | (F.col("score") == 0)
    before = Window.partitionBy("trip_id").orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    swept = cut(swept.join(seen.drop("score"), "trip_id").withColumn("_ended", F.coalesce(F.max(over).over(before), F.lit(False))).filter("not _ended").drop("_ended"))
    near = F.col("time_s") <= F.col("near_s")
    bracket = swept.groupBy("trip_id").agg(F.coalesce(F.max(F.when(near, F.col("price"))), F.lit(1.0)).alias("lo"), F.min(F.when(~near, F.col("price"))).alias("hi"), F.first("near_s").alias("within_s")).withColumn("least", F.lit(-1.0))
    probes = bisected(trips, region, bracket, SWEEP_PROBES, CLOSE)
    pool = _all(fast, [swept.drop("near_s", "most_s"), *probes]).join(limits.drop("score"), "trip_id").filter("time_s is null or time_s <= most_s")
    best = frontier(pool).withColumn("recommended", F.row_number().over(Window.partitionBy("trip_id").orderBy(F.desc_nulls_last(F.when(F.col("time_s") <= F.col("near_s"), F.col("time_s"))), "score")) == 1)
    offered = spread(best.drop("near_s", "most_s"), "trip_id", ["time_s", "score"], MAX_OPTIONS, F.col("recommended"))
    return offered.withColumn("option", F.row_number().over(Window.partitionBy("trip_id").orderBy("time_s", "score")) - 1)


def route_trips(trips: DataFrame, edges: DataFrame, moves: DataFrame, starts: DataFrame | None = None, mode: str = "fastest", value: float = 0.0, exposure: DataFrame | None = None) -> DataFrame:
    """trip_id, option, recommended, time_s, length_m, turns, score, edges, start_m, end_m of trips (trip_id, src, dst, or points as in solve).

    mode: "fastest", "priced" (value: seconds a site), "budget" (value: extra share of time) or "options".
    """
    region = Region(edges, moves, starts, exposure)
    if mode == "options":
        found = alternatives(trips, region)
    else:
        found = within_budget(trips, region, value) if mode == "budget" else solve(at_prices(trips, F.lit(value if mode == "priced" else 0.0)), region)
        found = found.withColumns({"option": F.lit(0), "recommended": F.lit(True)})
    return found.select("trip_id", "option", "recommended", "time_s", "length_m", "turns", "score", "edges", "start_m", "end_m")


def costs_from(sources: DataFrame, edges: DataFrame, moves: DataFrame, starts: DataFrame | None = None, price: float = 0.0) -> DataFrame:
    """source, edge_id, cost to the end of every edge that sources (node) reach."""
    region = Region(edges, moves, starts)
    name, parts = region.name, region.parts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["node"].tolist():
                found = _graph(name, parts).search(s, None, price)
                yield pd.DataFrame({"source": s, "edge_id": list(found), "cost": list(found.values())})

    return sources.select("node").mapInPandas(run, "source long, edge_id long, cost double")


def random_numbers(seed: int) -> Iterator[float]:
    """Repeatable numbers in [0, 1) of a 32-bit generator (mulberry32), the same in any language."""
    state, full = seed & 0xFFFFFFFF, 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & full
        x = ((state ^ (state >> 15)) * (state | 1)) & full
        x ^= (x + (((x ^ (x >> 7)) * (x | 61)) & full)) & full
        yield ((x ^ (x >> 14)) & full) / 4294967296


def drawn_trips(nodes: DataFrame, n: int, least_m: float, most_m: float, seed: int = 1, tries: int = 100) -> DataFrame:
    """trip_id, src, dst of the first n drawn pairs of nodes (node, x, y, i from 0) whose straight distance lies within limits. Same pairs as sample_trips."""
    spark, size = nodes.sparkSession, nodes.count()
    draw = random_numbers(seed)
    pairs = [(k, int(next(draw) * size), int(next(draw) * size)) for k in range(n * tries if size else 0)]
    drawn = spark.createDataFrame(pairs, "k long, a long, b long")  # n * tries rows
    end = lambda name: nodes.select(F.col("i").alias(name), F.struct("node", "x", "y").alias(f"{name}n"))
    ends = drawn.join(end("a"), "a").join(end("b"), "b")
    away = F.hypot(F.col("an.x") - F.col("bn.x"), F.col("an.y") - F.col("bn.y"))
    first = ends.filter(away.between(least_m, most_m)).orderBy("k").limit(n)
    return first.select((F.row_number().over(Window.orderBy("k")) - 1).cast("long").alias("trip_id"), F.col("an.node").alias("src"), F.col("bn.node").alias("dst"))  # n rows


def sample_trips(nodes: pd.DataFrame, n: int, least_m: float, most_m: float, seed: int = 1, tries: int = 100) -> list[tuple[int, int]]:
    """n pairs of nodes (node, x, y) whose straight distance lies within limits."""
    draw, out = random_numbers(seed), []
    ids, xs, ys = nodes["node"].tolist(), nodes["x"].tolist(), nodes["y"].tolist()
    for _ in range(n * tries):
        if len(out) == n or not ids:
            break
        a, b = int(next(draw) * len(ids)), int(next(draw) * len(ids))
        if least_m <= math.hypot(xs[a] - xs[b], ys[a] - ys[b]) <= most_m:
            out.append((ids[a], ids[b]))
    return out
