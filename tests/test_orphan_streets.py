"""Addresses that no street takes, as streets of their own."""

import random

from wayglass.operators import places as pl

SCHEMA = "addr_id long, street string, x double, y double"


def test_orphans_by_name_and_distance(spark):
    rows = [
        (1, "LBJ FREEWAY", 0.0, 0.0), (2, "LBJ Freeway", 390.0, 0.0), (3, "LBJ FREEWAY", 780.0, 0.0), (4, "LBJ Fwy", 5000.0, 0.0), (5, "OLD MILL ROAD", -10.0, 0.0), (6, "OLD MILL ROAD", -10.0, 0.0),
        (7, "12 Main Street", 0.0, 0.0), (8, "Main, Dallas", 0.0, 0.0), (9, None, 0.0, 0.0), (10, "Elm Street", None, 0.0), (11, "Taken Street", 0.0, 0.0), (12, "LBJ Freeway", 1181.0, 0.0),
    ]
    matched = spark.createDataFrame([(11,)], "addr_id long")
    got = {r["addr_id"]: (r["street_id"], r["name"]) for r in pl.orphan_streets(spark.createDataFrame(rows, SCHEMA), matched).collect()}
    lbj = (1, "LBJ Freeway")
    assert got == {1: lbj, 2: lbj, 3: lbj, 4: (4, "LBJ Fwy"), 5: (5, "Old Mill Road"), 6: (5, "Old Mill Road"), 12: (12, "LBJ Freeway")}
    assert pl.orphan_streets(spark.createDataFrame([], SCHEMA), matched).count() == 0


def test_orphans_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["Oak Lane", "Elm Court"]), rnd.uniform(-4000, 4000), rnd.uniform(-900, 900)) for i in range(150)]
    root = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 400.0**2 and root[b[0]] < root[a[0]]:
                    root[a[0]], changed = root[b[0]], True
    got = pl.orphan_streets(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "addr_id long")).collect()
    assert {r["addr_id"]: r["street_id"] for r in got} == root and len(set(root.values())) > 3
