"""From ways to a routable graph: splitting, lengths, headings, restrictions, transitions, strong components. All joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.functions import geo
from wayglass.plans.iterate import cut, until_stable


def split_ways(refs: DataFrame) -> DataFrame:
    """way_id, geom (number within the way), k, node: ways (way_id, k, node) cut at their ends and at nodes used more than once.

    A cut node is the last vertex of one geometry and the first of the next.
    """
    used = refs.groupBy("node").agg(F.count(F.lit(1)).alias("uses"))
    w = Window.partitionBy("way_id").orderBy("k")
    rows = refs.join(used, "node").withColumns({"first": F.row_number().over(w) == 1, "last": F.lead("k").over(w).isNull()})
    rows = rows.withColumn("is_cut", F.col("first") | F.col("last") | (F.col("uses") > 1))
    rows = rows.withColumn("geom", F.sum(F.col("is_cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a cut that isn't the way's first vertex also ends the geometry before
    also = F.when(F.col("is_cut"), F.when(F.col("first"), F.array("geom")).when(F.col("last"), F.array(F.col("geom") - 1)).otherwise(F.array(F.col("geom") - 1, "geom"))).otherwise(F.array("geom"))
    return rows.withColumn("geom", F.explode(also)).select("way_id", F.col("geom").cast("int").alias("geom"), "k", "node")


def with_lengths(vertices: DataFrame) -> DataFrame:
    """vertices (way_id, geom, k, node, x, y, ...) with len (to the vertex before) and s (running distance)."""
    w = Window.partitionBy("way_id", "geom").orderBy("k")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return vertices.withColumn("len", step).withColumn("s", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def point_along(vertices: DataFrame, at: Column) -> DataFrame:
    """way_id, geom, px, py: the point at distance `at` along each geometry of with_lengths()."""
    w = Window.partitionBy("way_id", "geom").orderBy("k")
    rows = vertices.withColumns({"x0": F.lag("x").over(w), "y0": F.lag("y").over(w), "at": F.least(at, F.max("s").over(Window.partitionBy("way_id", "geom")))})
    here = rows.filter((F.col("len") > 0) & (F.col("s") >= F.col("at")) & (F.col("s") - F.col("len") <= F.col("at")))
    t = (F.col("at") - (F.col("s") - F.col("len"))) / F.col("len")
    return here.groupBy("way_id", "geom").agg(F.min_by(F.struct((F.col("x0") + t * (F.col("x") - F.col("x0"))).alias("px"), (F.col("y0") + t * (F.col("y") - F.col("y0"))).alias("py")), "k").alias("p")).select("way_id", "geom", "p.px", "p.py")


def transitions(edges: DataFrame, bans: DataFrame | None = None) -> DataFrame:
    """e, f, via, turn, turn_s, is_uturn: legal moves between edges (edge_id, geom_id, src, dst, heading or h0 and h1).

    The way back is legal only at a dead end; banned moves (e, f) are left out.
    """
    h1 = "h1" if "h1" in edges.columns else "heading"
    h0 = "h0" if "h0" in edges.columns else "heading"
    exits = edges.groupBy(F.col("src").alias("via")).agg(F.count(F.lit(1)).alias("exits"))
    a = edges.select(F.col("edge_id").alias("e"), F.col("dst").alias("via"), F.col("geom_id").alias("ge"), F.col(h1).alias("hin"))
    b = edges.select(F.col("edge_id").alias("f"), F.col("src").alias("via"), F.col("geom_id").alias("gf"), F.col(h0).alias("hout"))
    moves = a.join(b, "via").join(exits, "via").withColumn("is_uturn", F.col("ge") == F.col("gf")).filter("not is_uturn or exits = 1")
    moves = moves.withColumn("turn", geo.wrap180(F.col("hout") - F.col("hin")))
    if bans is not None:
        moves = moves.join(bans.select("e", "f"), ["e", "f"], "left_anti")
    return moves.select("e", "f", "via", "turn", geo.turn_cost("turn").alias("turn_s"), "is_uturn")


def resolve_restrictions(restrictions: DataFrame, edges: DataFrame) -> DataFrame:
    """e, f banned by restrictions (rid, kind, from_way, via, to_way). edges: edge_id, way_id, src, dst, h0, h1.

    Several candidate pairs are narrowed to the turn that the kind names; an only_* bans every other exit of its approaches.
    """
    a = edges.select(F.col("edge_id").alias("e"), F.col("way_id").alias("from_way"), F.col("dst").alias("via"), F.col("h1").alias("hin"))
    b = edges.select(F.col("edge_id").alias("f"), F.col("way_id").alias("to_way"), F.col("src").alias("via"), F.col("h0").alias("hout"))
    pairs = restrictions.join(a, ["from_way", "via"]).join(b, ["to_way", "via"])
    named = F.regexp_replace("kind", "^[a-z]+_", "")
    named = F.when(named == "left_turn", "left").when(named == "right_turn", "right").when(named == "straight_on", "straight").when(named == "u_turn", "u")
    pairs = pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("rid")))
    pairs = pairs.filter((F.col("n") == 1) | named.isNull() | (geo.turn_class(geo.wrap180(F.col("hout") - F.col("hin"))) == named))
    no = pairs.filter(F.col("kind").startswith("no_")).select("e", "f")
    only = pairs.filter(~F.col("kind").startswith("no_")).select("rid", "via", "e", "f")
    others = only.select("rid", "via", "e").distinct().join(b.select("f", "via"), "via").join(only.select("rid", "e", "f"), ["rid", "e", "f"], "left_anti")
    return no.unionByName(others.select("e", "f")).distinct()


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: everything reached from seeds (node) along edges (src, dst), level by level."""
    links = cut(edges.select("src", "dst").distinct())
    start = seeds.select("node").distinct()

    def step(state: DataFrame) -> DataFrame:
        return state.unionByName(state.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))).distinct()

    return until_stable(start, step, ["node"])


def contracted(edges: DataFrame, names: DataFrame, width: int, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """One round of contraction: strong components within blocks of `width` node numbers become single nodes. Blocks of over `most` edges wait for the loop.

    edges: src, dst. names: node, of (the node that it has become). What is strongly connected within a block is so in the whole, so the answer stays.
    The last result says whether every edge lay within a block that was solved: then no component is left to be found.
    """
    block = F.floor(F.col("src") / width)
    inner = edges.withColumn("block", block).filter(block == F.floor(F.col("dst") / width))
    sizes = cut(inner.groupBy("block").agg(F.count(F.lit(1)).alias("n")))
    small = sizes.filter(F.col("n") <= most).select("block")
    solved = sizes.filter(F.col("n") <= most).agg(F.sum("n")).first()[0] or 0
    whole = solved == edges.count()

    def solve(key, rows):
        import pandas as pd

        groups: dict[int, list[int]] = {}
        for node, c in strong_components(rows["src"].tolist(), rows["dst"].tolist()).items():
            groups.setdefault(c, []).append(node)
        pairs = [(node, min(nodes)) for nodes in groups.values() if len(nodes) > 1 for node in nodes if node != min(nodes)]
        return pd.DataFrame(pairs, columns=["was", "now"])

    merged = cut(inner.join(small, "block").groupBy("block").applyInPandas(solve, "was long, now long"))
    into = lambda df, column: df.join(merged, F.col(column) == F.col("was"), "left").withColumn(column, F.coalesce("now", column)).drop("was", "now")
    return cut(into(into(edges, "src"), "dst").filter("src <> dst").distinct()), cut(into(names, "of")), whole


def largest_scc(edges: DataFrame, width: int = 4096, rounds: int = 3, most: int = 1_000_000) -> DataFrame:
    """node of the largest strongly connected component, the one with the smallest node among equals.

    First, components within blocks of neighbouring node numbers are contracted, in ever wider blocks. On what is left: forward and backward
    reach of the heaviest node; what is found is taken out until nothing larger can be left.
    """
    rest = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    names = cut(rest.select(F.col("src").alias("node")).unionByName(rest.select(F.col("dst").alias("node"))).distinct().withColumn("of", F.col("node")))
    whole = False
    for k in range(rounds):
        rest, names, whole = contracted(rest, names, width * 64**k, most)
        if whole:
            break
    weights = cut(names.groupBy(F.col("of").alias("node")).agg(F.count(F.lit(1)).alias("w"), F.min("node").alias("least")))
    best, size, least = None, 0, None
    if whole:
        best = weights.orderBy(F.desc("w"), "least").limit(1)
    while not whole:
        top = weights.orderBy(F.desc("w"), "least").limit(1).collect()
        if not top:
            break
        pivot = weights.filter(F.col("node") == top[0]["node"]).select("node")
        back = rest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = cut(reached(rest, pivot).join(reached(back, pivot), "node").join(weights, "node"))
        own = found.agg(F.sum("w").alias("w"), F.min("least").alias("least")).first()
        if own["w"] > size or own["w"] == size and own["least"] < least:
            best, size, least = found, own["w"], own["least"]
        weights = cut(weights.join(found.select("node"), "node", "left_anti"))
        left = weights.agg(F.sum("w")).first()[0] or 0
        if left < size:
            break
        gone = found.select("node")
        rest = cut(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if best is None:
        return names.select("node").limit(0)
    return names.join(best.select(F.col("node").alias("of")), "of").select("node")


def strong_components(src: list[int], dst: list[int]) -> dict[int, int]:
    """node: number of its strongly connected component. Two passes of depth-first search without recursion."""
    out: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    for a, b in zip(src, dst, strict=True):
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    order, seen = [], set()
    for root in sorted(out.keys() | back.keys()):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out.get(root, ())))]
        while stack:
            node, rest = stack[-1]
            for b in rest:
                if b not in seen:
                    seen.add(b)
                    stack.append((b, iter(out.get(b, ()))))
                    break
            else:
                order.append(node)
                stack.pop()
    found: dict[int, int] = {}
    for number, root in enumerate(reversed(order)):
        if root in found:
            continue
        found[root], stack = number, [root]
        while stack:
            for a in back.get(stack.pop(), ()):
                if a not in found:
                    found[a] = number
                    stack.append(a)
    return found


def largest_scc_by_region(edges: DataFrame) -> DataFrame:
    """region, node of each region's largest strongly connected component: regions are bounded (routing.MAX_EDGES), so one task solves one region.

    For a single graph of any size there is largest_scc(), a relational loop.
    """
    import pandas as pd

    def solve(key, rows):
        found = strong_components(rows["src"].tolist(), rows["dst"].tolist())
        size: dict[int, list[int]] = {}
        for node, c in found.items():
            size.setdefault(c, []).append(node)
        best = min(size.values(), key=lambda nodes: (-len(nodes), min(nodes)), default=[])
        return pd.DataFrame({"region": [key[0]] * len(best), "node": best})

    return edges.select("region", "src", "dst").groupBy("region").applyInPandas(solve, "region int, node long")


def relaxed_costs(edges: DataFrame, moves: DataFrame, sources: DataFrame) -> DataFrame:
    """source, edge_id, cost to the edge's end: shortest paths as a relational loop, for graphs of any size.

    edges: edge_id, src, time_s. moves: e, f, cost (of the turn and of what f adds beyond its time).
    """
    start = sources.select(F.col("node").alias("source")).join(edges, F.col("source") == F.col("src")).select("source", "edge_id", F.col("time_s").alias("cost"))
    ahead = cut(moves.join(edges.select(F.col("edge_id").alias("f"), "time_s"), "f").select("e", "f", (F.col("cost") + F.col("time_s")).alias("step")))

    def step(state: DataFrame) -> DataFrame:
        on = state.join(ahead, F.col("edge_id") == F.col("e")).select("source", F.col("f").alias("edge_id"), (F.col("cost") + F.col("step")).alias("cost"))
        return state.unionByName(on).groupBy("source", "edge_id").agg(F.min("cost").alias("cost"))

    return until_stable(start, step, ["source", "edge_id", "cost"])


def new_sites(moves: DataFrame, exposure: DataFrame) -> DataFrame:
    """e, f, w: weight of the sites on f that a vehicle doesn't bring along from the end of e. exposure: edge_id, site, at_end, weight."""
    on = moves.select("e", "f").join(exposure.select(F.col("edge_id").alias("f"), "site", "weight"), "f")
    carried = exposure.filter("at_end").select(F.col("edge_id").alias("e"), "site")
    return on.join(carried, ["e", "site"], "left_anti").groupBy("e", "f").agg(F.sum("weight").alias("w"))
