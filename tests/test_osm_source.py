"""The map source: filters that it takes, splits, odd XML, and the rules for roads and restrictions."""

import gzip
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from wayglass.sources import osm_source as osm

XML = """<?xml version='1.0'?><osm>
<node id="1" lat="1.5" lon="-3" version="2"/>
<node id="2" lat='2.5' lon="4"><tag k="highway" v="traffic_signals"/><tag v="a &amp; &lt;b&gt; > c" k="name"/></node>
<way id="10"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/><tag k="maxspeed" v="30 mph"/></way>
<way id="11"><nd ref="1"/><nd ref="2"/><tag k="highway" v="footway"/></way>
<way id="12"></way>
<way id="13"><nd ref="1"/><nd ref="2"/><tag k="highway" v="service"/></way>
<way id="14"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/><tag k="area" v="yes"/></way>
<way id="15"><nd ref="2"/><nd ref="1"/><tag k="highway" v="motorway"/></way>
<way id="16"><nd ref="2"/><tag k="highway" v="motorway"/></way>
<relation id="5"><member type="way" ref="10" role="from"/><member type="node" ref="1" role="via"/><member type="way" ref="15" role="to"/><tag k="type" v="restriction"/><tag k="restriction" v="no_left_turn"/></relation>
<relation id="6"><member type="way" ref="10" role="from"/><member type="way" ref="11" role="via"/><member type="way" ref="15" role="to"/><tag k="type" v="restriction"/><tag k="restriction" v="no_left_turn"/></relation>
<relation id="7"><tag k="type" v="restriction"/><tag k="restriction" v="no_left_turn"/><tag k="except" v="psv;motorcar"/></relation>
<relation id="8"><member type="way" ref="10" role="from"/><tag k="type" v="multipolygon"/></relation></osm>
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("osm")
    (path / "a.osm").write_text(XML)
    (path / "_SUCCESS").write_text("")
    return path


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("split", [None, 97, 300])
def test_every_object_once_however_the_file_is_cut(spark, folder, split):
    ways = osm.scan(spark, str(folder), "way", ("highway",), split)
    assert sorted((r["id"], tuple(r["refs"]), r["highway"]) for r in ways.collect()) == [
        (10, (1, 2), "primary"), (11, (1, 2), "footway"), (12, (), None), (13, (1, 2), "service"), (14, (1, 2), "primary"), (15, (2, 1), "motorway"), (16, (2,), "motorway")
    ]
    nodes = osm.scan(spark, f"file://{folder}/a.osm", "node", ("name",), split).orderBy("id").collect()
    assert [(r["id"], r["version"], r["lat"], r["lon"], r["name"]) for r in nodes] == [(1, 2, 1.5, -3.0, None), (2, None, 2.5, 4.0, "a & <b> > c")]
    assert osm.scan(spark, str(folder), "relation", (), split).count() == 4


CONDITIONS = (
    "highway = 'primary'", "highway <> 'primary'", "highway in ('primary', 'motorway') and id > 10", "highway is null", "highway is not null and not (highway in ('service'))", "highway like 'mot%'", "highway like '%way'",
    "highway like '%ima%'", "id between 11 and 13", "highway <=> null", "not (highway <=> 'service')", "highway = 'primary' or id = 12", "size(refs) > 1 and highway = 'motorway'", "all_tags['area'] = 'yes'", "version is null and id <> 15",
)


@pytest.mark.parametrize("condition", CONDITIONS)
def test_rows_are_the_same_with_and_without_pushed_filters(spark, folder, condition):
    ways = osm.scan(spark, str(folder), "way", ("highway",))
    table = spark.createDataFrame(ways.collect(), ways.schema)  # no source that could take a filter
    pushed, plain = (sorted(r["id"] for r in df.filter(condition).collect()) for df in (ways, table))
    assert pushed == plain


def test_the_plan_shows_what_the_source_takes(spark, folder):
    text = plan(osm.scan(spark, str(folder), "way", ("highway",)).filter("highway = 'primary' and id > 3 and size(refs) > 1"))
    assert "EqualTo(highway,primary)" in text and "GreaterThan(id,3)" in text
    condition = text.split("Condition : ")[1].split("\n")[0]
    assert "size(refs" in condition and "primary" not in condition


def test_gzip_and_missing_files_and_bad_options(spark, folder, tmp_path):
    with gzip.open(tmp_path / "b.osm.gz", "wt") as f:
        f.write(XML)
    assert osm.scan(spark, str(tmp_path), "way", (), 500).count() == 7
    with pytest.raises(Exception, match="(?i)not.?found|nowhere"):
        osm.scan(spark, str(tmp_path / "nowhere"), "way").collect()
    with pytest.raises(Exception, match="can't be columns"):
        osm.scan(spark, str(folder), "way", ("refs",))
    with pytest.raises(Exception, match="kind is"):
        osm.scan(spark, str(folder), "area")


def test_roads_signals_and_restrictions(spark, folder):
    roads = {r["id"]: r for r in osm.drivable_ways(spark, str(folder)).collect()}
    assert set(roads) == {10, 15} and (roads[15]["fwd"], roads[15]["rev"], roads[15]["kmh"]) == (True, False, 105.0) and round(roads[10]["kmh"], 3) == 48.28
    assert set(r["id"] for r in osm.drivable_ways(spark, str(folder), include_service=True).collect()) == {10, 13, 15}
    assert [r["id"] for r in osm.signals(spark, str(folder)).collect()] == [2]
    assert sorted(tuple(r) for r in osm.turn_restrictions(spark, str(folder)).collect()) == [(5, "no_left_turn", 10, 1, 15, True), (6, "no_left_turn", 10, None, 15, False)]


def test_objects_that_are_written_read_back(spark, tmp_path):
    rows = [(1, [5, 6], {"name": 'a "b" <c> & d\n', "highway": "x"}), (2, [], {})]
    df = spark.createDataFrame(rows, "id long, refs array<long>, tags map<string,string>")
    df.select(osm.element("way", "id")).write.text(str(tmp_path / "out"))
    got = {r["id"]: (r["refs"], r["all_tags"]) for r in osm.scan(spark, str(tmp_path / "out"), "way").collect()}
    assert got == {1: ([5, 6], rows[0][2]), 2: ([], {})}
    assert osm.scan(spark, str(tmp_path / "out"), "way").agg(F.max("id")).first()[0] == 2
