"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from workload import oracle, queries
from workload.compare import connect, differences

SF_DIR = entry_point.SMALL


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(queries.queries()) <= set(entry_point.queries())


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 20 and sum(r.problem == "" for r in rows) == 11


@pytest.mark.parametrize("name", queries.queries())
def test_query_equals_sql(spark, connection, name):
    assert differences(queries.queries()[name](spark, SF_DIR), connection, oracle.oracle_sql()[name]) == []
