from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = Path("/root/testdata/sf0.001")


def test_sql_is_of_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not SMALL.exists(), reason="driver tables are not here")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"host", "score", "features", "level"} == set(rows[0].asDict())
