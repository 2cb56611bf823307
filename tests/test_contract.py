"""Driver contract: entry() runs on sf0.001; every oracle has a query."""

import os

import pytest

import __spark_entry__ as entry

SMOKE = "/root/testdata/sf0.001"


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 26


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="benchmark tables not present")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "feed_id", "stop_id", "stop_name", "stop_lat", "stop_lon", "stop_timezone"]
    assert df.count() >= 0
