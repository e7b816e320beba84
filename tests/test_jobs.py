"""Release jobs, sources of binary files, replication and prompts on small inputs with known answers."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayglass import commands
from wayglass.operators import jobs, lines
from wayglass.sources import feeds, packs
from wayglass.streaming.feeds import Refused, Replica, Snapshots, Unreachable, follow_changes


def region(id_, batch="a", box=(0.0, 0.0, 1.0, 1.0), sources=("us/texas",)):
    return {"id": id_, "name": id_, "batch": batch, "west": box[0], "south": box[1], "east": box[2], "north": box[3], "sources": list(sources)}


@pytest.fixture
def config(tmp_path):
    path = tmp_path / "regions.json"

    def write(*regions):
        path.write_text(json.dumps({"regions": list(regions)}))
        return str(path)

    return write


def test_plan_and_region_checks(spark, config):
    good = config(region("b-1", "x"), region("a-1", "y", sources=("us/ok", "us/texas")), region("a-2", "y", sources=("us/texas", "us/nm")))
    rows = [(r["batch"], r["regions"], r["sources"]) for r in commands.plan(spark, good).collect()]
    assert rows == [("y", ["a-1", "a-2"], ["us/ok", "us/texas", "us/nm"]), ("x", ["b-1"], ["us/texas"])]
    assert commands.plan(spark, good, "b-1").count() == 1
    with pytest.raises(KeyError):
        commands.plan(spark, good, "nowhere")
    for bad in (region("Upper"), region("box", box=(1.0, 0.0, 0.0, 1.0)), region("twice", sources=("s", "s")), region("none", sources=())):
        with pytest.raises(ValueError):
            commands.regions_of(spark, config(region("ok"), bad))
    with pytest.raises(ValueError):
        commands.regions_of(spark, config(region("ok"), region("ok")))


def test_assemble_and_prune(spark, config, tmp_path):
    release = str(tmp_path / "release")
    conf = config(*[region(x) for x in "cabde"])
    entry = lambda *rows: spark.createDataFrame(rows, commands.ENTRY)
    commands.write_part(entry(("a", 2, "bm-a"), ("c", 2, None)), release, "one")
    commands.write_part(entry(("z", 2, "bm")), release, "two")
    live = tmp_path / "live.json"
    live.write_text(json.dumps({"schema": 2, "regions": [{"id": i, "version": 1, "basemap": "bm"} for i in "abd"]}))
    out = commands.assemble(spark, conf, release, str(live), ["a", "b", "c", "z"]).collect()
    assert [(r["id"], r["version"], r["origin"]) for r in out] == [("a", 2, "fresh"), ("b", 1, "live")]  # c has no basemap, d no feed, z isn't configured
    both = commands.assemble(spark, conf, release, str(live), ["a", "b", "c"], basemap="country")
    assert [(r["id"], r["basemap"]) for r in both.collect()] == [("c", "country"), ("a", "country"), ("b", "country")]
    assert feeds.manifest(spark, f"{release}/manifest/*.json").count() == 3
    assert commands.same_manifest(both, both) and not commands.same_manifest(both, both.limit(1))
    with pytest.raises(RuntimeError):
        commands.assemble(spark, conf, release, str(live), [])
    (tmp_path / "list.txt").write_text("packs/a 2024-01-01T00:00:00Z\npacks/b 2024-01-01T00:00:00Z\npacks/ 2024-01-01T00:00:00Z\nbasemap/assets/x 2024-01-01T00:00:00Z\nplaces/new 2024-01-02T20:00:00Z\nother/x 2024-01-01T00:00:00Z\npacks/c soon\n")
    gone = commands.prune(spark, str(tmp_path / "list.txt"), spark.createDataFrame([("packs/a",)], "key string"), 24.0, "2024-01-03T00:00:00Z")
    assert [r["key"] for r in gone.collect()] == ["packs/b"]


def test_reports_of_parts(spark):
    parts = spark.createDataFrame([("a", "pack", 1, "n/a"), ("b", "pack", 2, "n/b"), ("c", "pack", 3, "n/c")], "id string, kind string, fingerprint int, path string")
    live = spark.createDataFrame([("a", "pack", 1, "l/a"), ("b", "pack", 9, "l/b")], "id string, kind string, fingerprint int, path string")
    assert {r["id"]: (r["path"], r["reused"]) for r in jobs.reused(parts, live).collect()} == {"a": ("l/a", True), "b": ("n/b", False), "c": ("n/c", False)}


def test_binary_sources(spark, tmp_path):
    head = bytearray(127)
    head[:8] = b"PMTiles\x03"
    head[100:102] = bytes([0, 15])
    struct.pack_into("<iiii", head, 102, -1_066_000_000, 258_000_000, -935_000_000, 365_000_000)
    (tmp_path / "a.pmtiles").write_bytes(bytes(head) + b"tiles")
    r = feeds.basemaps(spark, str(tmp_path / "a.pmtiles")).first()
    assert (r["west"], r["south"], r["east"], r["north"], r["min_zoom"], r["max_zoom"]) == (-106.6, 25.8, -93.5, 36.5, 0, 15)
    (tmp_path / "z.bin").write_bytes(gzip.compress(b"packed"))
    (tmp_path / "p.bin").write_bytes(b"plain")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.bin"))
    assert sorted(bytes(r["content"]) for r in feeds.inflated(files).select("content").collect()) == [b"packed", b"plain"]
    arrays = {
        "geom_ptr": np.array([0, 2, 5], np.uint32), "geom_dlon": np.array([10, 1, 100, -5, 3], np.int32), "geom_dlat": np.array([7, 1, -50, 2, 2], np.int32), "geom_label": np.array([1, 0], np.uint32), "labels": np.frombuffer("\0Main\0".encode(), np.uint8),
    }
    packs.write(spark, str(tmp_path / "g.fwr"), packs.packed({}, arrays))
    packs.write(spark, str(tmp_path / "g.fwr"), packs.packed({}, arrays))  # over what is there
    assert [tuple(r)[1:] for r in packs.vertices(spark, str(tmp_path / "g.fwr")).orderBy("geom_id", "k").collect()] == [(0, 0, 10, 7), (0, 1, 11, 8), (1, 0, 100, -50), (1, 1, 95, -48), (1, 2, 98, -46)]
    assert [r["label"] for r in packs.geom_labels(spark, str(tmp_path / "g.fwr")).orderBy("geom_id").collect()] == ["Main", ""]
    assert not list(tmp_path.glob("*.partial"))


def test_replica_follows_change_files(spark, tmp_path):
    rows = lambda *pairs: spark.createDataFrame([(i, v, False) for i, v in pairs], "id long, version long, deleted boolean")
    source, waits, state = str(tmp_path / "changes"), [], {"latest": 3}
    for n, change in ((1, rows((1, 2))), (2, rows((2, 3))), (3, rows((9, 1))), (4, rows((9, 2))), (5, rows((1, 7)))):
        change.write.parquet(f"{source}/{n}.parquet")
    table = Snapshots(spark, str(tmp_path / "table"))
    replica = Replica(table, source, lambda: state["latest"], lambda: (rows((1, 1), (2, 1), (3, 1)), 1), waits.append)
    now = lambda: {r["id"]: r["version"] for r in table.current().collect()}
    assert replica.update() == (1, True) and now() == {1: 1, 2: 1, 3: 1}
    assert replica.update(chunk=1) == (3, True) and now() == {1: 1, 2: 3, 3: 1, 9: 1}
    assert replica.update() == (3, False)
    assert replica.update(rewind=2)[0] == 3 and now() == {1: 1, 2: 3, 3: 1, 9: 1}
    state["latest"] = 5
    assert replica.update() == (5, True) and now() == {1: 7, 2: 3, 3: 1, 9: 2}
    state["latest"] = 7  # files 6 and 7 are gone: a full copy again
    replica.fresh = lambda: (rows((1, 8), (2, 8), (3, 8)), 7)
    assert replica.update() == (7, True) and now() == {1: 8, 2: 8, 3: 8}
    state["latest"] = None
    with pytest.raises(Unreachable):
        replica.update()
    assert waits == [10.0, 30.0, 60.0]


def test_a_refused_chunk_is_not_passed_over(spark, tmp_path):
    rows = lambda ids, v, deleted=False: spark.createDataFrame([(i, v, deleted) for i in ids], "id long, version long, deleted boolean")
    source = str(tmp_path / "changes")
    for n, change in ((2, rows(range(7), 2, True)), (3, rows([20], 1)), (4, rows(range(100, 120), 1))):
        change.write.parquet(f"{source}/{n}.parquet")
    table, state = Snapshots(spark, str(tmp_path / "table")), {"latest": 3}
    replica = Replica(table, source, lambda: state["latest"], lambda: (rows(range(10), 1), 1))
    assert replica.update() == (1, True)
    for _ in range(2):  # the same again, file 3 isn't read before file 2 is in
        with pytest.raises(Refused, match="shrunk"):
            replica.update(chunk=1)
        assert replica.position() == 1 and table.current().count() == 10
    reader = table.current()
    assert replica.update(chunk=1, force=True) == (3, True)
    assert {r["id"] for r in table.current().collect()} == {7, 8, 9, 20} and reader.count() == 10
    replica.fresh = lambda: (rows([1], 9), 9)
    state["latest"] = 9  # files are gone, and the full copy has shrunk
    with pytest.raises(Refused):
        replica.update()
    assert replica.position() == 3
    assert replica.update(force=True) == (9, True) and table.current().count() == 1
    # a version that is written again goes beside the one that readers have
    before = table.current()
    assert table.publish(rows([1, 2], 10), 9) == "ok" and table.current().count() == 2 and before.count() == 1 and replica.position() == 9


def test_a_refused_batch_stops_the_stream(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "id long, version long, deleted boolean"
    put = lambda ids, deleted: spark.createDataFrame([(i, 1 + deleted, deleted) for i in ids], schema).coalesce(1).write.mode("append").parquet(source)
    table = Snapshots(spark, str(tmp_path / "table"))
    run = lambda **how: follow_changes(spark.readStream.schema(schema).parquet(source), table, state, **how).awaitTermination()
    put(range(10), False)
    run()
    put(range(8), True)
    for _ in range(2):
        with pytest.raises(Exception, match="refused"):
            run()
        assert table.current().count() == 10
    run(force=True)
    assert {r["id"] for r in table.current().collect()} == {8, 9}


def test_follow_changes_as_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for n, pairs in enumerate([[(1, 1), (2, 1)], [(2, 5), (3, 1)]]):
        spark.createDataFrame(pairs, "id long, version long").coalesce(1).write.mode("append").parquet(source)
    table = Snapshots(spark, str(tmp_path / "table"))
    stream = spark.readStream.schema("id long, version long").option("maxFilesPerTrigger", 1).parquet(source)
    follow_changes(stream, table, str(tmp_path / "state")).awaitTermination()
    assert {r["id"]: r["version"] for r in table.current().collect()} == {1: 1, 2: 5, 3: 1}


def test_prompts_and_banners(spark):
    steps = spark.createDataFrame([(1, 0, "depart", 0.0), (1, 1, "turn", 1000.0), (1, 2, "turn", 1150.0), (1, 3, "arrive", 3000.0)], "route_id long, step int, kind string, at_m double")
    fixes = spark.createDataFrame([(1, k, a, 20.0) for k, a in enumerate((100.0, 450.0, 500.0, 900.0, 950.0, 1050.0, 1400.0, 2500.0, 2900.0))], "route_id long, fix long, along_m double, speed double")
    said = sorted((r["fix"], r["step"], r["said"]) for r in lines.prompts(steps, fixes).collect())
    # early at 600 m for the first; the second is said along with it; the last is announced early and again
    assert said == [(1, 1, "early"), (3, 1, "now"), (5, 2, "now"), (7, 3, "early"), (8, 3, "now")]
    rows = spark.createDataFrame([(1, k, ms, s) for k, (ms, s) in enumerate([(0, "zone"), (1000, "clear"), (1600, "clear"), (2000, "ring"), (2500, "zone"), (3900, "ahead"), (4100, "ahead")])], "vehicle long, event_id long, ms long, state string")
    rank = F.when(F.col("state") == "zone", 3).when(F.col("state") == "ring", 2).otherwise(0)
    shown = lines.held(rows.withColumn("ts", F.timestamp_millis("ms")).drop("ms"), rank).orderBy("event_id").collect()
    assert [r["shown"] for r in shown] == ["zone", "zone", "clear", "ring", "zone", "zone", "ahead"]


def test_place_index(spark, tmp_path):
    streets = spark.createDataFrame([(1, "Main Street", "T", 0.0, 0.0, False), (2, "Main Street", "T", 300.0, 0.0, False), (3, "Long Boulevard", "T", 0.0, 0.0, True), (4, "Long Boulevard", "T", 1500.0, 0.0, True), (5, "Main Street", "T", 5000.0, 0.0, False)], "street_id long, name string, town string, x double, y double, major boolean")
    from wayglass.operators.places import street_pieces

    assert {r["street_id"]: r["piece"] for r in street_pieces(streets).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    addresses = spark.createDataFrame([(1, "Main St", "12", 10.0, 0.0), (2, "main street", "12", 20.0, 0.0), (3, "Main St", "9", 290.0, 0.0), (4, "Elsewhere", "1", 0.0, 0.0)], "addr_id long, street string, number string, x double, y double")
    index = commands.place_index(streets, addresses, str(tmp_path / "index"))
    assert [(r["street_id"], r["lead"]) for r in index.orderBy("street_id", "lead").collect()] == [(1, 9), (1, 12)]
    assert spark.read.parquet(str(tmp_path / "index/addresses")).count() == 2 and spark.read.parquet(str(tmp_path / "index/streets")).count() == 3


def test_numbers_over_ranges(spark):
    from wayglass.plans.iterate import numbered, until_stable

    rows = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "v long")
    assert all(r["v"] == r["i"] for r in numbered(rows, ["v"]).collect())
    with pytest.raises(RuntimeError):
        until_stable(rows, lambda df: df.withColumn("v", F.col("v") + 1), ["v"], most=2)
