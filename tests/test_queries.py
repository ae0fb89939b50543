"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from strataforge.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: Without SQL: DuckDB has no ratio of matching blocks; tests/test_measures.py holds it against all pairs.
NO_SQL = {"resembling_passages"}


def test_every_query_has_sql():
    assert set(QUERIES) - NO_SQL == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) == ""
