"""Exposure that follows changes against exposure worked out anew, the nearest join and medians against brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from wayglass.operators import cameras as cam
from wayglass.operators.evaluate import medians
from wayglass.operators.proximity import nearest_at_any_distance
from wayglass.streaming import exposure as ex
from wayglass.streaming.feeds import Refused

CHANGE = "id long, x double, y double, direction string, brand string, version long, deleted boolean"


@pytest.fixture
def roads(spark):
    """A lattice of 6 x 6 crossings, 300 m apart, and one road of 20 km."""
    rows = [(2 * (7 * i + j) + t, 0, 300.0 * i, 300.0 * j, 300.0 * (i + (t == 0)), 300.0 * (j + (t == 1)), 0.0, True) for i in range(6) for j in range(6) for t in (0, 1)]
    rows.append((999, 0, 0.0, -40.0, 20000.0, -40.0, 0.0, True))
    seg = spark.createDataFrame(rows, "geom_id long, k int, ax double, ay double, bx double, by double, s0 double, is_last boolean")
    e = seg.withColumn("rev", F.explode(F.array(F.lit(False), F.lit(True)))).select((F.col("geom_id") * 2 + F.col("rev").cast("int")).alias("edge_id"), "geom_id", "rev", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("len"))
    return seg, e


def rounded(df):
    return sorted((r["edge_id"], r["site"], round(r["entry_m"], 6), round(r["exit_m"], 6), round(r["units"], 6), r["at_end"]) for r in df.collect())


def anew(spark, roads, state):
    rows = [(i, *v[:4]) for i, v in state.items() if v[0] is not None]
    c = spark.createDataFrame(rows, "id long, x double, y double, direction string, brand string")
    return rounded(cam.exposure(*roads, cam.camera_zones(c), cam.capture_sites(c)))


def test_view_equals_exposure_anew(spark, roads, tmp_path):
    rnd = random.Random(4)
    place = lambda: (rnd.uniform(-20, 1800), rnd.choice([0.0, 300.0, 600.0, -30.0]) + rnd.uniform(-15, 15), rnd.choice(["45", "90;270", None, "N", "x"]), rnd.choice(["Flock Safety", "Other", None]))
    state = {i: place() for i in range(40)} | {100: (500.0, 0.0, None, None), 101: (520.0, 0.0, None, None), 102: (540.0, 0.0, "90", None), 103: (None, None, "90", None), 104: (15000.0, -35.0, "90", None)}
    view = ex.ExposureView(spark, str(tmp_path / "view"), *roads, buckets=64)
    assert view.exposure().count() == 0 and view.cameras() is None
    batch = lambda rows: spark.createDataFrame(rows, CHANGE)
    assert view.apply(batch([(i, *v, 1, False) for i, v in state.items()]), 0)
    assert rounded(view.exposure()) == anew(spark, roads, state)
    before = view.versions()

    # the middle of a chain goes, so that its site falls apart; cameras move, come and join sites; old versions, repeats and changes without id change nothing
    changes = [(101, None, None, None, None, 2, True), (7, 505.0, 5.0, "90", None, 2, False), (200, 1200.0, 302.0, None, None, 1, False), (200, 1200.0, 302.0, None, None, 1, False), (8, 1.0, 1.0, None, None, 0, False), (None, 3.0, 3.0, None, None, 9, False)]
    del state[101]
    state |= {7: (505.0, 5.0, "90", None), 200: (1200.0, 302.0, None, None)}
    assert view.apply(batch(changes), 1)
    want = anew(spark, roads, state)
    assert rounded(view.exposure()) == want
    far = view.versions()
    assert sum(v == 0 for b, v in far.items() if b >= 0) >= 1 and set(far) <= set(before) | {-1}  # the far camera's bucket is carried over as it is
    assert not view.apply(batch(changes), 1)

    # a gate that refuses leaves everything as it was
    gone = batch([(i, None, None, None, None, 5, True) for i in state if i != 104])
    with pytest.raises(Refused):
        view.apply(gone, 2)
    assert rounded(view.exposure()) == want and view.versions() == far
    assert view.apply(gone, 2, force=True)
    assert rounded(view.exposure()) == anew(spark, roads, {104: state[104]})


def test_stream_of_camera_changes(spark, roads, tmp_path):
    source, state = tmp_path / "changes", {i: (100.0 * i, 10.0, None, None) for i in range(12)}
    view = ex.ExposureView(spark, str(tmp_path / "view"), *roads)

    def run():
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(source))
        ex.follow_cameras(stream, view, str(tmp_path / "checkpoint")).awaitTermination()

    spark.createDataFrame([(i, *v, 1, False) for i, v in state.items()], CHANGE).coalesce(1).write.mode("append").parquet(str(source))
    run()
    state[3] = (310.0, 290.0, None, None)
    spark.createDataFrame([(3, *state[3], 2, False)], CHANGE).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert rounded(view.exposure()) == anew(spark, roads, state)
    assert view.versions()[-1] == 1


def test_near_segments_loses_no_sample(spark, roads):
    rnd = random.Random(1)
    cams = spark.createDataFrame([(rnd.uniform(-100, 21000), rnd.uniform(-120, 1900)) for _ in range(30)], "x double, y double")
    hit = lambda seg: {(r["geom_id"], r["j"]) for r in cam.samples(seg).crossJoin(cams.toDF("x2", "y2")).filter("hypot(x - x2, y - y2) <= 62").collect()}
    some = ex.near_segments(roads[0], cams, 62.0)
    assert hit(some) == hit(roads[0]) and 0 < some.count() < roads[0].count()


def test_nearest_at_any_distance(spark):
    rnd = random.Random(2)
    town = [(i, rnd.gauss(0, 40), rnd.gauss(0, 40)) for i in range(150)] + [(200, 9000.0, 9000.0), (201, 9000.0, 9000.0), (202, None, 1.0), (203, math.nan, 1.0)]
    asked = [(i, rnd.uniform(-200, 200), rnd.uniform(-200, 200)) for i in range(60)] + [(100, 7000.0, -5000.0), (101, 9000.0, 9001.0), (102, -1e6, 3.0), (103, None, 2.0), (104, math.inf, 2.0), (105, 8.0, 8.0), (106, 8.0, 8.0)]
    points, targets = spark.createDataFrame(asked, "id long, x double, y double"), spark.createDataFrame(town, "t long, x2 double, y2 double")
    finite = lambda rows: [r for r in rows if r[1] is not None and math.isfinite(r[1])]
    want = {i: min((math.hypot(x - a, y - b), t) for t, a, b in finite(town)) for i, x, y in finite(asked)}
    got = {r["id"]: (r["dist"], r["t"]) for r in nearest_at_any_distance(points, targets, "id", "t", 16.0).collect()}
    assert {i: t for i, (_, t) in got.items()} == {i: t for i, (_, t) in want.items()} and got[101][1] == 200
    assert all(got[i][0] == pytest.approx(want[i][0], abs=1e-6) for i in want)
    for a, b in ((points, targets.limit(0)), (points.limit(0), targets)):
        assert nearest_at_any_distance(a, b, "id", "t", 16.0).count() == 0


def test_medians(spark):
    rnd = random.Random(3)
    rows = [("hot", 5.0)] * 300 + [("hot", rnd.random() * 10) for _ in range(201)] + [("even", v) for v in (4.0, 1.0, 2.0, 8.0)] + [("one", 7.0), ("one", None), ("none", None)]
    got = {r["g"]: (r["n"], r["median"]) for r in medians(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v").collect()}
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert got == {g: (len(v), statistics.median(v)) for g, v in want.items()}
    assert medians(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0
