"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors of one label (and length) are spread over regions, each small enough for a task. A region is cut into overlapping shards; over each shard a graph is
built in which a vector keeps a near neighbour only if no kept one is much nearer to it (robust pruning), and the shards' adjacency lists are united. Every vector then asks
the graph: a greedy search starts from the shards' medoids, and whatever it finds near the threshold is expanded further until nothing new within that range turns up. What is found is verified in
double precision. In each region the vectors whose id is divisible by `audit_every` are also compared with the whole region; if the search has found less than `recall`
of their links, the region is searched again with a beam twice as wide.

Labels with more vectors than a region holds are split around centres fitted on a bounded sample, each vector going to its `overlap` nearest ones, again and again until all regions are small enough;
a pair that meets in several regions counts in the first of those that both chose. A cell that its centres can't tell apart (vectors much closer to
each other than to anything else) is dealt into blocks instead, and every two blocks make a region of their own. Equal vectors are one node with a multiplicity from the start, so that copies never meet in a region.
Regions return numbers of links and their components' roots, never pairs.

Defined results: every row is a vector of its own, rows that repeat an id too; vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
link with nothing; vectors of unlike lengths don't link; ids that are null count, and are a component's id only if it has no other; lengths are scaled by the largest component first, so that very
large and very small components neither overflow nor vanish; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import lean, written


@dataclass(frozen=True)
class GraphRules:
    cosine: float = 0.93
    #: Vectors of a region, and of a shard's graph.
    region: int = 8192
    shard: int = 1024
    #: Centres that an oversized region is split around, vectors sampled for each, nearest centres a vector goes to, and centres on the driver at a time.
    branch: int = 32
    sample: int = 16
    overlap: int = 3
    centres: int = 65_536
    #: Neighbours that are looked at and kept, and how much nearer a kept one has to be to make another superfluous.
    near: int = 48
    far: int = 16
    degree: int = 24
    alpha: float = 1.2
    beam: int = 48
    #: Cosine under the threshold that the range search still expands.
    slack: float = 0.06
    audit_every: int = 50
    recall: float = 0.99


def robust_prune(dist: np.ndarray, cand: np.ndarray, of: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each row the candidates that stay (-1: none), nearest first. dist: all distances of the shard; cand: a row of candidates for each vector of `of`, -1 where there is none."""
    there = (cand >= 0) & (cand != of[:, None])
    d = np.where(there, dist[of[:, None], cand], np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    alive = np.isfinite(d)
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    kept = np.full((len(of), degree), -1, np.int64)
    rows = np.arange(len(of))
    for k in range(degree):
        at = alive.argmax(1)
        have = alive[rows, at]
        if not have.any():
            break
        best = cand[rows, at]
        kept[have, k] = best[have]
        alive[rows, at] = False
        alive &= ~(have[:, None] & (alpha * dist[best[:, None], cand] <= d))
    return kept


def shard_graph(unit: np.ndarray, rules: GraphRules) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of one shard's unit vectors. Where fewer than two vectors kept one, the two nearest that it keeps lead back to it, so that every vector can be reached."""
    n = len(unit)
    if n == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    dist = np.sqrt(np.maximum(2 - 2 * (unit @ unit.T), 0)).astype(np.float32)
    np.fill_diagonal(dist, np.inf)
    near = min(rules.near, n - 1)
    every = np.arange(n)
    cand = np.argpartition(dist, near - 1, axis=1)[:, :near]
    # some far ones, for long edges: a fixed walk over the shard
    far = (every[:, None] * 31 + (np.arange(1, rules.far + 1) * max(n // (rules.far + 1), 1))[None, :]) % n
    forward = robust_prune(dist, np.concatenate([cand, far], 1), every, rules.degree, rules.alpha)
    # edges back: each vector's list and those that chose it, nearest first, pruned once more
    src, k = np.nonzero(forward >= 0)
    dst = forward[src, k]
    order = np.lexsort((dist[dst, src], dst))
    src, dst = src[order], dst[order]
    starts = np.searchsorted(dst, every)
    place = np.arange(len(dst)) - starts[dst]
    back = np.full((n, 4 * rules.degree), -1, np.int64)
    fits = place < back.shape[1]
    back[dst[fits], place[fits]] = src[fits]
    both = robust_prune(dist, np.concatenate([forward, back], 1), every, rules.degree, rules.alpha)
    at, k = np.nonzero(both >= 0)
    reached = np.bincount(both[at, k], minlength=n)
    to, slot = np.nonzero((forward[:, :2] >= 0) & (reached < 2)[:, None])
    return np.concatenate([at, forward[to, slot]]), np.concatenate([both[at, k], to])


def fit_centres(sample: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """k centres of unit vectors: spread over the sample, then moved to the means of what is nearest to them."""
    k = min(k, len(sample))
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, sample)
        size = np.linalg.norm(total, axis=1)
        good = size > 0
        centres[good] = total[good] / size[good, None]
    return centres


def nearest_centres(unit: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the k nearest centres, nearest first."""
    k = min(k, len(centres))
    return np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :k]


def region_graph(unit: np.ndarray, rules: GraphRules) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency lists united over overlapping shards, and the shards' medoids."""
    n = len(unit)
    k = -(-2 * n // rules.shard) if n > rules.shard else 1
    if k == 1:
        shards = [np.arange(n)]
    else:
        chosen = nearest_centres(unit, fit_centres(unit[:: max(n // (k * rules.sample), 1)], k), 2)
        shards = []
        for c in range(k):
            rows = np.flatnonzero((chosen == c).any(1))
            # a cell of more than two shards' vectors is dealt out, each cell in another order
            parts = max(-(-len(rows) // (2 * rules.shard)), 1)
            deal = np.arange(len(rows)) if parts == 1 else (np.arange(len(rows)) * (2 * c + 1)) // 3
            shards += [rows[deal % parts == p] for p in range(parts)]
    lists, medoids = [], []
    for rows in shards:
        if not len(rows):
            continue
        a, b = shard_graph(unit[rows], rules)
        mean = unit[rows].mean(0)
        medoids.append(rows[int((unit[rows] @ mean).argmax())])
        lists.append((rows[a], rows[b]))
    src, dst = (np.concatenate(x) for x in zip(*lists))
    codes = np.unique(src * n + dst)
    src, dst = codes // n, codes % n
    starts = np.searchsorted(src, np.arange(n))
    place = np.arange(len(src)) - starts[src]
    adjacency = np.full((n, int(place.max()) + 1 if len(place) else 1), -1, np.int64)
    adjacency[src, place] = dst
    return adjacency, np.unique(medoids)


def range_search(unit: np.ndarray, adjacency: np.ndarray, medoids: np.ndarray, queries: np.ndarray, reach: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in queries, vector) of all vectors of cosine `reach` or more that the search meets: greedy from the medoids with a beam, then from all that is within reach."""
    n, m = len(unit), len(queries)
    asked, rows = unit[queries], np.arange(m)
    seen = np.zeros((m, n), bool)
    opened = np.zeros((m, n), bool)
    entry = medoids[np.argsort(-(asked @ unit[medoids].T), axis=1)[:, : min(4, beam)]]
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -np.inf, np.float32)
    e = entry.shape[1]
    ids[:, :e] = entry
    sims[:, :e] = np.einsum("qkd,qd->qk", unit[entry], asked)
    seen[rows[:, None], entry] = True
    hits = [np.argwhere(sims >= reach)]
    hits[0][:, 1] = ids[hits[0][:, 0], hits[0][:, 1]]
    width = 4
    active = rows
    while len(active):
        shut = ~np.take_along_axis(opened[active], np.maximum(ids[active], 0), 1) & (ids[active] >= 0)
        go = shut.any(1)
        active, shut = active[go], shut[go]
        if not len(active):
            break
        # the best ones of the beam that aren't opened; the beam is sorted
        first = np.argsort(~shut, axis=1, kind="stable")[:, :width]
        open_, valid = np.take_along_axis(ids[active], first, 1), np.take_along_axis(shut, first, 1)
        q, s = np.nonzero(valid)
        opened[active[q], open_[q, s]] = True
        around = np.where(valid[:, :, None], adjacency[np.maximum(open_, 0)], -1).reshape(len(active), -1)
        around.sort(axis=1)
        fresh = around >= 0
        fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
        fresh &= ~seen[active[:, None], np.maximum(around, 0)]
        q, s = np.nonzero(fresh)
        new = around[q, s]
        seen[active[q], new] = True
        sim = np.einsum("kd,kd->k", unit[new], asked[active[q]])
        within = sim >= reach
        hits.append(np.stack([active[q[within]], new[within]], 1))
        grid = np.full(around.shape, -np.inf, np.float32)
        grid[q, s] = sim
        both, whose = np.concatenate([sims[active], grid], 1), np.concatenate([ids[active], around], 1)
        top = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable"), 1)
        sims[active] = np.take_along_axis(both, top, 1)
        ids[active] = np.where(np.isfinite(sims[active]), np.take_along_axis(whose, top, 1), -1)
    found = np.concatenate(hits)
    frontier = found[~opened[found[:, 0], found[:, 1]]]
    while len(frontier):
        later = []
        for part in np.array_split(frontier, -(-len(frontier) // 8192)):
            opened[part[:, 0], part[:, 1]] = True
            around = adjacency[part[:, 1]]
            q = np.repeat(part[:, 0], around.shape[1]).reshape(around.shape)
            fresh = (around >= 0) & ~seen[q, np.maximum(around, 0)]
            codes = np.unique(q[fresh] * n + around[fresh])
            q, new = codes // n, codes % n
            seen[q, new] = True
            within = np.einsum("kd,kd->k", unit[new], asked[q]) >= reach
            later.append(np.stack([q[within], new[within]], 1))
        frontier = np.concatenate(later)
        found = np.concatenate([found, frontier])
    return found[:, 0], found[:, 1]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components with the links a-b added: label[i] is the smallest member that i is known to be joined with, a root being its own."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


@dataclass(frozen=True)
class Region:
    """What a region's search gives for each vector."""

    n_links: np.ndarray
    root: np.ndarray
    audited: np.ndarray
    missed: np.ndarray
    beam: int


def search_region(vectors: np.ndarray, weight: np.ndarray, audit: np.ndarray, rules: GraphRules, counts=None) -> Region:
    """vectors: rows in double precision. weight: how many vectors each stands for. audit: rows that are also compared with all. counts(i, j): which pairs count here."""
    n = len(vectors)
    exact = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = exact.astype(np.float32)
    adjacency, medoids = region_graph(unit, rules)
    queries = np.flatnonzero(audit)
    true = {}
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        for q, row in zip(block, exact[block] @ exact.T >= rules.cosine):
            true[int(q)] = int(row.sum() - row[q])
    beam = rules.beam
    reach = np.float32(rules.cosine - rules.slack)
    step = max((4 << 20) // n, 64)
    while True:
        links, own, label = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        for at in range(0, n, step):
            asked = np.arange(at, min(at + step, n))
            q, j = range_search(unit, adjacency, medoids, asked, reach, beam)
            i = asked[q]
            apart = i != j
            i, j = i[apart], j[apart]
            good = np.concatenate([np.einsum("kd,kd->k", exact[i[s : s + 65536]], exact[j[s : s + 65536]]) >= rules.cosine for s in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            i, j = i[good], j[good]
            label = _join(label, i, j)
            np.add.at(own, i, 1)
            if counts is not None:
                here = counts(i, j)
                i, j = i[here], j[here]
            np.add.at(links, i, weight[j])
        missed = np.zeros(n, np.int64)
        for q, k in true.items():
            missed[q] = k - own[q]
        if beam >= n or missed.sum() <= (1 - rules.recall) * sum(true.values()):
            return Region(links, label, audit, missed, beam)
        beam *= 2


def usable(embedding: Column) -> Column:
    """Not null, all components finite, not all zero."""
    numbers = F.transform(embedding, lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(numbers, bad) & F.exists(numbers, lambda x: x != 0), F.lit(False))


def _matrix(values: pa.ListArray) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(values), -1)
    return rows / np.abs(rows).max(1, keepdims=True)


def _units(values) -> np.ndarray:
    rows = _matrix(values)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


PLACED = "region string, node binary, id long, weight long, embedding array<{0}>, choices array<array<int>>"


def split_regions(nodes: DataFrame, rules: GraphRules, kind: str) -> DataFrame:
    """Regions of at most `region` vectors (twice that for two blocks of a cell). choices: for each split the children that the vector chose."""
    spark = nodes.sparkSession
    schema = PLACED.format(kind)
    placed, sizes = nodes, None
    wave = max(rules.centres // rules.branch, 1)
    while True:
        sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
        large = {r["region"]: r["n"] for r in sizes.filter((F.col("n") > rules.region) & ~F.col("region").contains("|")).orderBy(F.desc("n"), "region").limit(wave).collect()}
        if not large:
            return placed
        names = F.broadcast(spark.createDataFrame([(k, v) for k, v in large.items()], "region string, n_region long"))
        # a bounded sample for each: branch * sample members with the smallest hashes
        drawn = placed.join(names, "region").withColumn("r", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(7)), "node"))).filter(F.col("r") <= rules.branch * rules.sample)
        got = drawn.select("region", "embedding").toArrow()
        regions = np.array(got.column("region").to_pylist(), object)
        centres = {}
        for name in large:
            at = np.flatnonzero(regions == name)
            sample = _units(got.column("embedding").take(pa.array(at)))
            fitted = fit_centres(sample, rules.branch)
            # how much of the sample goes to the commonest children: a cell that doesn't come apart is dealt into blocks
            share = np.bincount(nearest_centres(sample, fitted, rules.overlap).ravel(), minlength=len(fitted)).max() / len(sample)
            centres[name] = (fitted if share <= 0.8 else None, -(-large[name] // (rules.region // 2)))
        known = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names_ = np.array(batch.column(0).to_pylist(), object)
                for name in sorted(set(names_) & set(known.value)):
                    rows = np.flatnonzero(names_ == name)
                    part = batch.take(pa.array(rows))
                    fitted, blocks = known.value[name]
                    if fitted is None:
                        block = np.array([int.from_bytes(x[8:16], "little") % blocks for x in part.column(1).to_pylist()])
                        who = np.repeat(np.arange(len(rows)), blocks)
                        other = np.tile(np.arange(blocks), len(rows))
                        low, high = np.minimum(block[who], other), np.maximum(block[who], other)
                        child = [f"{name}|{a}|{b}" for a, b in zip(low, high)]
                        choice = [c + [[int(b)]] for c, b in zip((part.column(5).to_pylist()[w] for w in who), block[who])]
                    else:
                        near = nearest_centres(_units(part.column(4)), fitted, rules.overlap)
                        who = np.repeat(np.arange(len(rows)), near.shape[1])
                        child = [f"{name}/{c}" for c in near.ravel()]
                        before = part.column(5).to_pylist()
                        choice = [before[w] + [sorted(int(c) for c in near[w])] for w in who]
                    part = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([pa.array(child), *part.columns[1:5], pa.array(choice, pa.list_(pa.list_(pa.int32())))], batch.schema.names)

        rest = placed.join(names, "region", "left_anti").select(placed.columns)
        placed = written(rest.unionByName(placed.join(names, "region", "left_semi").select(placed.columns).mapInArrow(lean(assign), schema)), "regions")


def _first_common(region: str, choices: list[list[list[int]]]):
    """Which pairs count in a region: at every split its child is the first that both vectors chose; of two blocks, pairs across them (of a block with itself, all)."""
    head, *blocks = region.split("|")
    taken = [int(c) for c in head.split("/")[1:]]
    depth = len(taken)
    if not depth and not blocks:
        return None
    widest = max((len(c[k]) for c in choices for k in range(depth)), default=1)
    table = np.full((len(choices), depth, widest), np.iinfo(np.int32).max, np.int64)
    for row, c in enumerate(choices):
        for k in range(depth):
            table[row, k, : len(c[k])] = c[k]
    block = np.array([c[-1][0] for c in choices]) if blocks else None

    def counts(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        good = np.ones(len(i), bool)
        for k in range(depth):
            same = (table[i, k][:, :, None] == table[j, k][:, None, :]).any(2)
            first = np.where(same, table[i, k], np.iinfo(np.int64).max).min(1)
            good &= first == taken[k]
        if block is not None and blocks[0] != blocks[1]:
            good &= block[i] != block[j]
        return good

    return counts


FOUND = "node binary, id long, n_links long, root binary, audited boolean, missed long, beam int"


def region_links(placed: DataFrame, rules: GraphRules) -> DataFrame:
    """Of each vector with links and each audited one: node, id, n_links (that count in this region), root (of its component here), audited, missed, beam."""

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes = table.column("node").to_pylist()
        # rows that repeat an id and its vector are one node; the same in every run
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        order = [k for p, k in enumerate(order) if not p or nodes[k] != nodes[order[p - 1]]]
        table = table.take(pa.array(order))
        nodes = [nodes[k] for k in order]
        vectors = _matrix(table.column("embedding"))
        ids = table.column("id").to_pylist()
        audit = np.array([i is not None and i % rules.audit_every == 0 for i in ids])
        counts = _first_common(table.column("region")[0].as_py(), table.column("choices").to_pylist())
        found = search_region(vectors, table.column("weight").to_numpy(), audit, rules, counts)
        grouped = np.bincount(found.root, minlength=len(nodes))[found.root] > 1
        out = np.flatnonzero(grouped | audit)
        return pa.table(
            [
                pa.array([nodes[k] for k in out], pa.binary()), pa.array([ids[k] for k in out], pa.int64()), pa.array(found.n_links[out]), pa.array([nodes[found.root[k]] for k in out], pa.binary()),
                pa.array(audit[out]), pa.array(found.missed[out]), pa.array(np.full(len(out), found.beam, np.int32)),
            ],
            ["node", "id", "n_links", "root", "audited", "missed", "beam"],
        )

    return placed.groupBy("region").applyInArrow(work, FOUND)


def keyed_vectors(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """id, node (16 bytes that stand for label and vector; null if it links with nothing), embedding, region (of its label and length)."""
    v, la = F.col(embedding), F.col(label).cast("string")
    same = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), la, v)), 16, "0") for seed in ("first", "second")]))
    fine = usable(v) & la.isNotNull()
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.when(fine, same).alias("node"), v.alias("embedding"), F.concat(F.translate(la, "/|", "__"), F.lit(":"), F.size(v).cast("string")).alias("region"))


def vector_graph(rows: DataFrame, rules: GraphRules = GraphRules(), *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links, component_id, kept) for every row, and region_links' table with its audit."""
    keyed = keyed_vectors(rows, vec_id, embedding, label)
    kind = dict(rows.dtypes)[embedding].removeprefix("array<").removesuffix(">")
    nodes = keyed.filter("node is not null")
    copies = written(nodes.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")
    one = nodes.join(copies, "node", "left").filter(F.col("n").isNull() | F.col("id").eqNullSafe(F.col("least")))
    empty = F.array().cast("array<array<int>>")
    one = one.select("region", "node", "id", F.coalesce("n", F.lit(1).cast("long")).alias("weight"), "embedding", empty.alias("choices"))
    found = written(region_links(split_regions(one, rules, kind), rules), "found")

    links = found.groupBy("node").agg(F.sum("n_links").alias("links"), F.min("id").alias("id"))
    joined = components(found.filter("node <> root"), "node", "root")
    named = links.join(joined, "node", "left").withColumn("c", F.coalesce("label", "node"))
    least = named.groupBy("c").agg(F.min("id").alias("component"))
    known = named.join(least, "c").select("node", "links", "component").join(copies, "node", "full")
    known = known.select("node", (F.coalesce("links", F.lit(0).cast("long")) + F.coalesce(F.col("n") - 1, F.lit(0).cast("long"))).alias("n_links"), F.coalesce("component", "least").alias("component"))
    out = keyed.select("id", "node").join(known, "node", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")), found


def audit_recall(rows: DataFrame, result: DataFrame, rules: GraphRules = GraphRules(), *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = 1024) -> DataFrame:
    """One row: true_links and found_links of the vectors whose id is divisible by audit_every, against all rows, in blocks of both."""
    keyed = keyed_vectors(rows, vec_id, embedding, label).filter("node is not null")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("region", F.pmod(F.xxhash64("id", "node"), F.lit(1 << 20)).alias("h")).agg(F.collect_list("id").alias("i"), F.collect_list("embedding").alias("e")).groupBy("region", (F.col("h") % -(-df.count() // block)).alias("b")).agg(
            F.flatten(F.collect_list("i")).alias(f"{name}_id"), F.flatten(F.collect_list("e")).alias(f"{name}_vectors")
        ).drop("b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (_units(batch.column(f"{s}_vectors")[k].values) for s in "ab")
                yield pa.RecordBatch.from_arrays([batch.column("a_id")[k].values, pa.array(((a @ b.T) >= rules.cosine).sum(1))], ["id", "n"])

    asked = blocks(keyed.filter(F.col("id") % rules.audit_every == 0), "a")
    pairs = asked.join(blocks(keyed, "b"), "region").select("a_id", "a_vectors", "b_id", "b_vectors")
    true = pairs.mapInArrow(lean(compare), "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("n"))
    return true.join(result.select(F.col("vec_id").alias("id"), "n_links"), "id").agg(F.sum("n").alias("true_links"), F.sum("n_links").alias("found_links"))
