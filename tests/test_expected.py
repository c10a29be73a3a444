"""Every registered query against its SQL at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import differences

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("key", list(queries()))
def test_query(spark, key):
    rows, problems = differences(spark, SF, queries()[key], oracle_sql().get(key))
    assert not problems
