"""Search and matching where names repeat all over the map."""

import pytest

from wayglass.operators import places as pl
from wayglass.plans import place_queries as pq

D = "/root/testdata/sf0.001"


def broadcasts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


@pytest.mark.parametrize("query", [pq.search_streets, pq.topk_search, pq.result_dedupe])
def test_the_index_is_never_broadcast(spark, query, monkeypatch):
    """Its files may be small and its words many: at most the few words that are asked for go to all tasks."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    few = query(spark, D)
    assert broadcasts(few) == 1
    monkeypatch.setattr(pl, "FEW_WORDS", 0)
    many = query(spark, D)
    assert broadcasts(many) == 0 and sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_a_common_name_meets_itself_nearby_alone(spark):
    """Streets of one name all over the map: an address meets those around it, the nearest of its best level wins, the smallest among equally near ones."""
    n = 400
    streets = [(3 * k + i, name, 4000.0 * k + x, 0.0) for k in range(n) for i, (name, x) in enumerate((("North Main Street", 0.0), ("Main Street", 900.0), ("Main Road", 0.0)))]
    streets = spark.createDataFrame(streets, "street_id long, name string, x double, y double")
    said = ("N Main St", "MAIN STREET", "Main", "S Main St", "Main Street", "Side Street", None)
    rows = [(7 * k + i, s, 4000.0 * k + (2500.0 if i == 4 else 450.0), 0.0) for k in range(n) for i, s in enumerate(said)]
    addresses = spark.createDataFrame(rows, "addr_id long, street string, x double, y double")
    found = pl.match_addresses(addresses, streets)
    got = {r["addr_id"]: (r["street_id"], r["level"]) for r in found.collect()}
    want = {7 * k + i: w for k in range(n) for i, w in enumerate(((3 * k, 0), (3 * k + 1, 0), (3 * k, 2), (3 * k, 1)))}
    for k in range(n):  # 2,500 m on: the next town's streets are 1,500 m away
        want[7 * k + 4] = (3 * k + 3, 1) if k < n - 1 else None
    assert got == {a: w for a, w in want.items() if w}
    assert all("cx" in line for line in found._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in line)


def test_fixes_and_places_of_one_position_do_not_meet_in_pairs(spark, monkeypatch):
    """300 fixes at one place, 300 addresses and 300 places at another: one pair of positions for each head start, the first by name wins."""
    from pyspark.sql import functions as F

    pairs = []
    join = pq.proximity_join
    monkeypatch.setattr(pq, "proximity_join", lambda *a, **b: pairs.append((out := join(*a, **b)).count()) or out)
    at = lambda n, key, x: spark.range(n).select(F.col("id").alias(key), F.lit(x).alias("x"), F.lit(0.0).alias("y"))
    monkeypatch.setattr(pq.src, "fixes", lambda *_: at(300, "event_id", 10.0).unionByName(spark.createDataFrame([(300, 5000.0, 0.0)], "event_id long, x double, y double")))
    monkeypatch.setattr(pq, "addresses", lambda *_: at(300, "addr_id", 20.0))
    for x, what in ((24.0, "p0"), (60.0, "a0")):
        monkeypatch.setattr(pq, "places", lambda *_, x=x: at(300, "place_id", x))
        assert {(r["event_id"], r["what"]) for r in pq.reverse_geocode(spark, "").collect()} == {(k, what) for k in range(300)}
    assert pairs == [2, 2]
