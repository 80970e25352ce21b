"""Every query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import check, views

from tallyloom.plans import registered

QUERIES, ORACLE = registered()


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    check(spark, con, sf_dir, QUERIES[name], ORACLE.get(name))


def test_sql_has_queries():
    assert ORACLE.keys() <= QUERIES.keys()
