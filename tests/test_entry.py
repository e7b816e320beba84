"""The driver contract, and a sample of queries against their SQL."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ("camera_direction_parse", "camera_zones", "transitions", "way_split", "turn_ban_pairs", "pareto_frontier", "street_keys", "search_streets", "version_diff", "publish_decision", "off_route_runs", "multiset_difference")


def test_names_and_sql_agree():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    plain = lambda df: df[cols].map(lambda v: None if pd.isna(v) else float(v) if isinstance(v, numbers.Number) else str(v)).astype(object).sort_values(cols, key=lambda s: s.map(str)).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)
