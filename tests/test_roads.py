"""Geometry, road graph, routing, directions and search on small maps with known answers."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayglass.functions import geo, roads
from wayglass.functions import text as tx
from wayglass.operators import cameras as cam
from wayglass.operators import graph as g
from wayglass.operators import guidance as gd
from wayglass.operators import places as pl
from wayglass.operators import release as rl
from wayglass.operators import routing
from wayglass.plans.iterate import component_labels


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_directions_of_cameras(spark):
    cases = {
        "45": [(45, 0)], "-30": [(330, 0)], "360": [(0, 0)], "90;270": [(90, 0), (270, 0)], "10-30": [(20, 10)], "350-10": [(0, 10)], "NE": [(45, 0)], "ssw": [(202.5, 0)], " 12.5 ; ": [(12.5, 0)],
        "forward": None, "fixed": None, "150000099": None, "": None, None: None, "45;x": None, "400-10": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", geo.parse_direction("t").alias("s")).orderBy("i").collect()
    for r, want in zip(df, cases.values(), strict=True):
        assert (None if r["s"] is None else [tuple(x) for x in r["s"]]) == want, r


def test_sector_distance(spark):
    cases = [((0, 40), 0), ((0, 70), 20), ((0, -25), 25), ((40, 0), 40 * math.sin(math.radians(60)))]
    for (x, y), want in cases:
        got = one(spark, geo.sector_distance(F.lit(float(x)), F.lit(float(y)), F.lit(0.0), F.lit(30.0), F.lit(50.0)).alias("d"))["d"]
        assert got == pytest.approx(want, abs=1e-9)


def test_scalar_functions(spark):
    r = one(
        spark, geo.wrap180(F.lit(190.0)).alias("w"), geo.turn_cost(F.lit(-90.0)).alias("left"), geo.turn_cost(F.lit(90.0)).alias("right"), geo.turn_cost(F.lit(170.0)).alias("back"), geo.turn_class(F.lit(-90.0)).alias("cls"),
        roads.parse_maxspeed(F.lit("30 mph")).alias("mph"), roads.parse_maxspeed(F.lit("walk")).alias("walk"), tx.street_key(F.lit("East Belt Line Road")).alias("key"), tx.loose_keys(F.lit("e belt line rd")).alias("loose"),
        tx.words(F.lit("O’Connor & Élm")).alias("words"), tx.tidy(F.lit("  DALLAS  TOWN ​"), True).alias("tidy"), tx.coordinates(F.lit("-80.8431 35.2271"), (-82.0, 34.0, -79.0, 36.0)).alias("point"),
    )
    assert (r["w"], r["left"], r["right"], r["back"], r["cls"]) == (-170, 9, 4, 15, "left")
    assert r["mph"] == pytest.approx(48.28032) and r["walk"] is None
    assert r["key"] == "e belt line rd" and tuple(r["loose"]) == ("belt line rd", "belt line")
    assert r["words"] == ["oconnor", "and", "elm"] and r["tidy"] == "Dallas Town" and tuple(r["point"]) == (-80.8431, 35.2271)


@pytest.fixture(scope="module")
def grid(spark):
    """Five by five streets of 200 m at 30 km/h, nodes 1 to 25 from south to north; the second row runs east only; a signal at node 14; no right turn from 12 by 17 to 18."""
    rows = []
    for n in range(1, 26):
        r, c = divmod(n - 1, 5)
        for m, dr, dc in ((n + 1, 0, 1), (n + 5, 1, 0)):
            if (dc and c == 4) or (dr and r == 4):
                continue
            for a, b, rev in ((n, m, False), (m, n, True)):
                if rev and dc and r == 1:
                    continue
                h = {(1, 0): 0.0, (0, 1): 90.0}[(dr, dc)] + (180.0 if rev else 0.0)
                br, bc = divmod(b - 1, 5)
                rows.append((len(rows), n * 2 + dr, a, b, 200.0, 24.0 + (8 if b == 14 else 0), h, bc * 200.0, br * 200.0))
    edges = spark.createDataFrame(rows, "edge_id long, geom_id long, src long, dst long, len double, time_s double, heading double, x double, y double")
    by = {(a, b): e for e, _, a, b, *_ in rows}
    bans = spark.createDataFrame([(by[12, 17], by[17, 18])], "e long, f long")
    return edges, g.transitions(edges, bans)


def test_routes_on_the_grid(spark, grid):
    edges, moves = grid
    cases = [(1, 25, 8 * 24 + 4), (12, 18, 24 + 9 + 24), (13, 19, 24 + 4 + 24), (10, 6, 24 + 4 + 96 + 4 + 24), (3, 3, 0)]
    trips = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "trip_id long, src long, dst long")
    got = {r["trip_id"]: r for r in routing.route_trips(trips, edges, moves).collect()}
    for i, (_, _, seconds) in enumerate(cases):
        assert got[i]["time_s"] == pytest.approx(seconds)
    assert got[0]["length_m"] == 1600 and got[0]["turns"] == 1


def test_search_equals_dijkstra_and_the_relational_loop(spark, grid):
    edges, moves = grid
    graph = routing.Graph(edges.toPandas(), moves.toPandas())
    for a in range(1, 26, 4):
        for b in range(1, 26):
            assert graph.search(a, b).cost == pytest.approx(graph.search(a, b, straight=False).cost)
    start = spark.createDataFrame([(1,)], "node long")
    kernel = {(r["source"], r["edge_id"]): r["cost"] for r in routing.costs_from(start, edges, moves).collect()}
    loop = {(r["source"], r["edge_id"]): r["cost"] for r in g.relaxed_costs(edges, moves.select("e", "f", F.col("turn_s").alias("cost")), start).collect()}
    assert kernel.keys() == loop.keys() and all(kernel[k] == pytest.approx(loop[k]) for k in loop)


def test_a_camera_is_worth_a_detour(spark, grid):
    edges, moves = grid
    e = {(r["src"], r["dst"]): r["edge_id"] for r in edges.collect()}
    w = spark.createDataFrame([(r["e"], r["f"], 1.0) for r in moves.collect() if r["f"] == e[6, 11]], "e long, f long, w double")
    with_w = moves.join(w, ["e", "f"], "left").fillna(0.0, ["w"])
    trip = spark.createDataFrame([(0, 1, 21)], "trip_id long, src long, dst long")
    options = routing.route_trips(trip, edges, with_w, mode="options").orderBy("option").collect()
    assert [(r["time_s"], r["score"]) for r in options][0] == (96.0, 1.0)
    assert len(options) == 1  # the detour takes 69 % longer
    budget = lambda extra: routing.route_trips(trip, edges, with_w, mode="budget", value=extra).first()["score"]
    assert budget(0.1) == 1 and budget(1.0) == 0
    graph = routing.Graph(edges.toPandas(), with_w.toPandas())
    assert graph.search(1, 21, 300.0).time_s == pytest.approx(162)
    region = routing.Region(edges, with_w)
    for near, recommended in ((0.1, [True, False]), (1.0, [False, True])):
        both = routing.alternatives(trip, region, 1.0, near).orderBy("option").collect()
        assert [(r["time_s"], r["score"]) for r in both] == [(96.0, 1.0), (162.0, 0.0)] and [r["recommended"] for r in both] == recommended


def test_places_within_a_block(spark, grid):
    """Both ways along one block, a one-way block with the goal behind (round on right turns), nodes as points, and what is met on parts of edges."""
    edges, moves = grid
    rows = edges.withColumn("rev", F.col("src") > F.col("dst"))
    g_ = lambda a, b: next(r["geom_id"] for r in rows.collect() if (r["src"], r["dst"]) == (a, b))
    one, east = g_(1, 6), g_(6, 7)
    trips = spark.createDataFrame([(0, one, 50.0, one, 150.0), (1, one, 150.0, one, 50.0), (2, east, 150.0, east, 50.0), (3, one, 0.2, one, 199.9)], "trip_id long, src_geom long, src_m double, dst_geom long, dst_m double")
    trips = trips.withColumns({"src": F.lit(None).cast("long"), "dst": F.lit(None).cast("long")})
    got = {r["trip_id"]: r for r in routing.route_trips(trips, rows, moves).collect()}
    assert [got[k]["time_s"] for k in range(4)] == pytest.approx([12, 12, 6 + 4 + 24 + 4 + 24 + 4 + 24 + 4 + 6, 24])
    assert got[0]["length_m"] == pytest.approx(100) and (got[0]["start_m"], got[0]["end_m"]) == (50.0, 150.0)
    e = {(r["src"], r["dst"]): r["edge_id"] for r in rows.collect()}
    seen = pd.DataFrame([(e[1, 6], 7, 120.0, 200.0, True, 1.0), (e[6, 11], 7, 0.0, 60.0, False, 1.0), (e[6, 11], 8, 100.0, 150.0, False, 1.0)], columns=["edge_id", "site", "entry_m", "exit_m", "at_end", "weight"])
    graph = routing.Graph(rows.toPandas(), moves.toPandas(), None, seen)
    north = g_(6, 11)
    at = lambda geom, m: routing.Place(geom=geom, at_m=m)
    scores = [graph.search(at(one, a), at(geom, b)).score for a, geom, b in ((10.0, one, 100.0), (10.0, one, 130.0), (10.0, north, 50.0), (10.0, north, 120.0))]
    assert scores == [0, 1, 1, 2]  # site 7 holds on over the node and counts once
    for a in (5.0, 77.0, 190.0):
        for b in range(1, 26, 3):
            for straight in (True, False):
                assert graph.search(at(one, a), b, 30.0, straight).cost == pytest.approx(graph.search(at(one, a), b, 30.0).cost)


def test_strong_components(spark):
    rows = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 8), (8, 9), (9, 7)]
    edges = spark.createDataFrame([(a, b, 0) for a, b in rows], "src long, dst long, region int")
    assert {r["node"] for r in g.largest_scc_by_region(edges).collect()} == {1, 2, 3}
    assert {r["node"] for r in g.largest_scc(edges).collect()} == {1, 2, 3}
    assert {r["node"] for r in g.largest_scc(edges, width=3, rounds=1).collect()} == {1, 2, 3}
    rng = random.Random(4)
    some = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]
    groups = {}
    for node, c in g.strong_components([a for a, _ in some], [b for _, b in some]).items():
        groups.setdefault(c, []).append(node)
    want = min(groups.values(), key=lambda nodes: (-len(nodes), min(nodes)))
    table = spark.createDataFrame(some, "src long, dst long")
    for how in ({"width": 7, "rounds": 1}, {"width": 7, "rounds": 2, "most": 5}, {}):
        assert sorted(r["node"] for r in g.largest_scc(table, **how).collect()) == sorted(want)


def test_components_of_a_chain(spark):
    cams = spark.createDataFrame([(0, 0.0, 0.0), (1, 20.0, 0.0), (2, 40.0, 0.0), (3, 90.0, 0.0)], "id long, x double, y double")
    assert {r["id"]: r["site"] for r in cam.capture_sites(cams).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    alone = component_labels(spark.range(2).select(F.col("id").alias("node")), spark.createDataFrame([], "a long, b long"))
    assert {r["node"]: r["label"] for r in alone.collect()} == {0: 0, 1: 1}


def test_spread_keeps_ends_and_recommended(spark):
    points = spark.createDataFrame([(t, k, float(k), 10.0 - k) for t, n in ((0, 9), (1, 3)) for k in range(n)], "trip long, option int, time_s double, score double")
    kept = routing.spread(points, "trip", ["time_s"], 4, F.col("option") == 1)
    found = {t: sorted(r["option"] for r in kept.filter(F.col("trip") == t).collect()) for t in (0, 1)}
    assert {0, 1, 8} <= set(found[0]) and len(found[0]) == 4
    assert found[1] == [0, 1, 2]


def way(cls="residential", name="", ref="", heading=0.0, ring=False):
    return {"cls": cls, "name": name, "ref": ref, "toward": "", "ring": ring, "heading": heading}


def say(spark, *rows):
    """Sentences of one route: legs of 200 m, north unless they say otherwise."""
    made = []
    for k, r in enumerate(rows):
        heading = r.get("heading", 0.0)
        made.append((1, k, r.get("cls", "residential"), r.get("name", ""), r.get("ref", ""), r.get("toward", ""), r.get("ring", False), heading, r.get("leaving", heading), r.get("length_m", 200.0), r.get("is_uturn", False), r.get("others", [])))
    return [r["sentence"] for r in gd.steps_of_legs(spark.createDataFrame(made, gd.LEGS)).orderBy("step").collect()]


def test_directions_in_words(spark):
    street = way(name="Side Street", heading=90.0)
    assert say(spark, {"name": "Main Street"}, {"name": "Oak Avenue", "heading": 90.0, "others": [way(name="Main Street")]}) == ["Head north on Main Street", "Turn right onto Oak Avenue", "Arrive at your destination"]
    assert say(spark, {"name": "Main Street"}, {"name": "Main Street", "others": [street]}) == ["Head north on Main Street", "Arrive at your destination"]
    ramp = say(
        spark, {"name": "Right Branch", "heading": 90.0}, {"cls": "motorway_link", "heading": 110.0, "others": [way(name="Right Branch", heading=90.0)]}, {"cls": "motorway", "name": "Stemmons", "ref": "I-35E", "heading": 90.0},
        {"cls": "motorway_link", "toward": "Downtown", "heading": 110.0, "others": [way("motorway", "Stemmons", "I-35E", 90.0)]}, {"name": "Exit Street", "heading": 180.0, "others": [way(name="Exit Street")]},
    )
    assert ramp == ["Head east on Right Branch", "Take the ramp on the right to I-35E", "Merge onto I-35E", "Take the exit on the right toward Downtown", "Turn right onto Exit Street", "Arrive at your destination"]
    ring = {"ring": True, "length_m": 30.0}
    out = way(name="First Street", heading=90.0)
    around = say(spark, {"name": "South Road"}, {**ring, "heading": 45.0}, {**ring, "heading": 0.0, "others": [out]}, {"name": "North Road", "heading": 0.0, "others": [way(ring=True)]})
    assert around == ["Head north on South Road", "At the roundabout, take the second exit onto North Road", "Arrive at your destination"]
    assert gd.steps_of_legs(spark.createDataFrame([], gd.LEGS)).count() == 0


def test_directions_at_links_forks_and_ends(spark):
    slip = {"cls": "primary_link", "heading": 45.0, "length_m": 30.0, "others": [way("primary", "Main Street")]}
    assert say(spark, {"cls": "primary", "name": "Main Street"}, slip, {"cls": "primary_link", "heading": 80.0, "length_m": 30.0}, {"name": "Oak Avenue", "heading": 90.0, "others": [way(name="Oak Avenue", heading=270.0)]}) == [
        "Head north on Main Street", "Turn right onto Oak Avenue", "Arrive at your destination",
    ]
    assert say(spark, {"name": "Main Street"}, {**slip, "heading": 10.0}, {"name": "Upper Street", "heading": 20.0})[1] == "Keep right onto Upper Street"
    assert say(spark, {"name": "Main Street"}, {"name": "Main Street", "heading": 180.0, "is_uturn": True})[1] == "Make a U-turn"
    fork = say(spark, {"name": "Main Street"}, {"name": "Left Street", "heading": -20.0, "others": [way(name="Right Street", heading=20.0)]})
    assert fork[1] == "Keep left onto Left Street"
    assert say(spark, {"name": "Main Street"}, {"name": "Broad Street", "others": [way(name="Side Street", heading=90.0)]})[1] == "Continue onto Broad Street"
    # a "continue" just before the next step isn't worth saying
    assert say(spark, {"name": "Main Street"}, {"name": "Broad Street", "length_m": 30.0, "others": [way(name="A", heading=90.0)]}, {"name": "Oak Avenue", "heading": 90.0, "others": [way(name="Broad Street")]})[1] == "Turn right onto Oak Avenue"
    assert say(spark, {"name": "South Road"}, {"ring": True, "heading": 45.0}) == ["Head north on South Road", "Enter the roundabout", "Arrive at your destination"]


def test_kinds_of_places(spark):
    cases = [
        ({"amenity": "hospital"}, ("Hospital", 3)), ({"aeroway": "aerodrome", "iata": "DFW"}, ("Airport", 3)), ({"aeroway": "aerodrome"}, ("Airport", 1)), ({"amenity": "bench", "shop": "yes"}, None), ({"amenity": "fuel"}, ("Gas station", 1)),
        ({"natural": "water", "water": "river"}, None), ({"natural": "water"}, ("Lake", 1)), ({"shop": "yes"}, ("Shop", 1)), ({"building": "yes"}, ("Building", 0)), ({"addr:housenumber": "12"}, ("Place", 0)), ({"amenity": "no"}, None), ({}, None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>").select("i", pl.kind_of().alias("k")).orderBy("i").collect()
    assert [None if r["k"] is None else tuple(r["k"]) for r in rows] == [k for _, k in cases]


def test_search_ranks_whole_names(spark):
    names = spark.createDataFrame([(0, "Main Street", "Gridville"), (1, "Mainland Road", "Gridville"), (2, "Oak Avenue", "Main Town")], "id long, name string, town string")
    table = pl.entries(names, "id", F.col("name"), None, F.col("town"))
    asked = spark.createDataFrame([(0, "main st"), (1, "mai"), (2, "oak main"), (3, "zzz"), (4, "m")], "qid long, q string")
    got = {(r["qid"], r["entry_id"]): r["score"] for r in pl.score_entries(asked, table).collect()}
    assert got == {(0, 0): 9.0, (1, 0): 2.0, (1, 1): 2.0, (2, 2): 4.0}


def test_dedupe_of_addresses_follows_what_is_kept(spark):
    rows = [(1, "5", k, float(x), 0.0) for k, x in enumerate((0, 50, 100, 150, 300))]
    got = pl.dedupe_addresses(spark.createDataFrame(rows, "street_id long, number string, addr_id long, x double, y double"))
    assert sorted(r["addr_id"] for r in got.collect()) == [0, 2, 4]


def test_decisions(spark):
    case = lambda same, ok, live, full, changed, age: one(spark, rl.decision(F.lit(same), F.lit(ok), F.lit(live), F.lit(full), F.lit(changed), F.lit(age).cast("double")).alias("d"))["d"]
    assert case(True, True, True, False, 0.0, 1) == "unchanged" and case(False, False, True, True, 0.5, 1) == "hold"
    assert case(False, True, False, False, 0.0, 1) == "publish" and case(False, True, True, True, 0.0, 1) == "publish"
    assert case(False, True, True, False, 0.01, 1) == "publish" and case(False, True, True, False, 0.001, 7) == "publish"
    assert case(False, True, True, False, 0.001, None) == "publish" and case(False, True, True, False, 0.001, 2) == "defer"


def test_vehicles():
    from wayglass.streaming.vehicles import follow

    t = pd.Timestamp("2024-01-01", tz="UTC")
    fix = lambda s, along, off=5.0: (t + pd.Timedelta(seconds=s), along, off, 10.0, 5.0)
    rows = pd.DataFrame([fix(0, 100.0), fix(10, 700.0), fix(5, 600.0), fix(20, 650.0, 90.0), fix(21, 660.0, 90.0), fix(22, 670.0, 90.0), fix(30, 980.0)], columns=["ts", "along", "off_m", "speed", "accuracy"])
    state = {"furthest": 0.0, "strikes": 0, "rerouted": 0.0, "told": {}, "arrived": False}
    out = follow(rows, state, [(7, 680.0, 720.0)], 1000.0)
    assert [(e, s) for _, e, s, _ in out] == [("ahead", 7), ("zone", 7), ("reroute", None), ("arrived", None)]
    assert state["furthest"] == 980.0


def test_snapshots(spark, tmp_path):
    from wayglass.streaming.feeds import Snapshots

    s = Snapshots(spark, str(tmp_path / "feed"))
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, version long")
    assert s.publish(rows(range(10), 1), 0) == "ok" and s.publish(rows(range(4), 2), 1) == "shrunk" and s.publish(rows([], 2), 2) == "empty"
    assert s.current().count() == 10
    assert s.merge(rows([3, 12], 5), 3) == "ok"
    assert {r["id"]: r["version"] for r in s.current().collect()} == {i: 5 if i in (3, 12) else 1 for i in [*range(10), 12]}


def test_sources(spark, tmp_path):
    from wayglass.sources import feeds, osm

    (tmp_path / "a.osm").write_text(
        '<osm><node id="1" version="2" lat="32.5" lon="-96.5"><tag k="highway" v="traffic_signals"/></node><node id="2" version="1" lat="32.6" lon="-96.4"/>'
        '<way id="9" version="1"><nd ref="1"/><nd ref="2"/><tag k="highway" v="residential"/></way><relation id="5" version="1"><member type="way" ref="9" role="from"/><member type="node" ref="2" role="via"/><member type="way" ref="9" role="to"/>'
        '<tag k="type" v="restriction"/><tag k="restriction" v="no_u_turn"/></relation></osm>'
    )
    path = str(tmp_path / "a.osm")
    assert [(r["id"], dict(r["tags"])) for r in osm.nodes(spark, path).orderBy("id").collect()] == [(1, {"highway": "traffic_signals"}), (2, {})]
    assert [tuple(r) for r in osm.way_refs(osm.ways(spark, path)).orderBy("k").collect()] == [(9, 0, 1), (9, 1, 2)]
    assert tuple(osm.restrictions(osm.relations(spark, path)).first()) == (5, "no_u_turn", 9, 2, 9)
    (tmp_path / "list.txt").write_text("packs/a.fwr 2024-01-02T03:04:05Z\npacks/b.fwr soon\nNone\n")
    assert [(r["key"], r["modified"] is None) for r in feeds.listing(spark, str(tmp_path / "list.txt")).collect()] == [("packs/a.fwr", False), ("packs/b.fwr", True)]
    assert feeds.tile_origins(-97, 32, -96, 33) == [(20, -100)]
    (tmp_path / "t.poly").write_text("texas\n1\n   -97.0 32.0\n   -96.0 32.0\n   -96.0 33.0\nEND\n!2\n   -96.5 32.2\n   -96.4 32.2\n   -96.4 32.3\nEND\nEND\n")
    got = feeds.polygons(spark, str(tmp_path / "t.poly")).orderBy("ring").collect()
    assert [(r["hole"], len(r["points"])) for r in got] == [(False, 3), (True, 3)]


def test_packs(spark, tmp_path):
    import numpy as np

    from wayglass.sources import packs

    arrays = {
        "node_out_ptr": np.array([0, 1, 2], np.uint32), "edge_dst": np.array([1, 0], np.uint32), "edge_geom": np.array([0, 0], np.uint32), "edge_flags": np.array([0, 1], np.uint8), "edge_time": np.array([24, 24.5], np.float32),
        "edge_class": np.array([0, 0], np.uint8), "edge_h0": np.array([9000, 27000], np.uint16), "edge_h1": np.array([9000, 27000], np.uint16), "labels": np.frombuffer(b"\0Main\0", np.uint8),
    }
    data = packs.packed({"highway_classes": ["residential"]}, arrays)
    meta, back = packs.unpacked(data)
    assert meta == {"highway_classes": ["residential"]} and all((back[k] == v).all() for k, v in arrays.items()) and packs.strings(back["labels"]) == ["", "Main"]
    packs.write(spark, str(tmp_path / "a.fwr"), data)
    assert [(r["src"], r["dst"], r["rev"], r["h0"]) for r in packs.road_edges(spark, str(tmp_path / "a.fwr")).orderBy("edge_id").collect()] == [(0, 1, False, 90.0), (1, 0, True, 270.0)]
    assert packs.sections(spark, str(tmp_path / "a.fwr")).count() == len(arrays) and packs.headers(spark, str(tmp_path / "a.fwr")).count() == 1
    with pytest.raises(ValueError):
        packs.unpacked(b"nope" + data[4:])
    assert packs.restarted(np.array([5, 1, 1, 7, 2]), np.array([0, 3])).tolist() == [5, 6, 7, 7, 9]


def test_polygons_reports_and_trips(spark):
    from wayglass.functions.polygons import area_km2, clipped, outline

    square = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]
    assert clipped(square, (1.0, 1.0, 3.0, 3.0)) and area_km2(clipped(square, (1.0, 1.0, 3.0, 3.0))) == pytest.approx(111.32**2 * math.cos(math.radians(1.5)))
    assert clipped(square, (5.0, 5.0, 6.0, 6.0)) == [] and '"Polygon"' in outline([square])
    text = rl.report(spark.createDataFrame([("a", "published", None, 5), ("b", "failed", "no map", None)], "region string, status string, why string, edges int"))
    assert text.index("| b |") < text.index("| a |")
    nodes = pd.DataFrame({"node": range(50), "x": [k * 100.0 for k in range(50)], "y": 0.0})
    picked = routing.sample_trips(nodes, 5, 500, 2000)
    assert len(picked) == 5 and picked == routing.sample_trips(nodes, 5, 500, 2000) and all(500 <= abs(a - b) * 100 <= 2000 for a, b in picked)
