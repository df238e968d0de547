"""Every registered query against its SQL check."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from veilscan.catalog import queries as core

# The training-data queries have tests of their own in tests/llm.
QUERIES = {k: v for k, v in queries().items() if k in core.QUERIES}
ORACLES = {k: v for k, v in oracle_sql().items() if k in core.QUERIES}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name not in ORACLES:
        assert df.count() > 0
        return
    ok, note = compare(df, con.sql(ORACLES[name]))
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == [
        "batch_id", "file_path", "categories", "total_matches", "protection_level", "file_format", "recommendations",
    ]
    assert df.count() > 0
