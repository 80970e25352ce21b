"""Queries of the subpackage over empty tables and over tables with null rows and clashing columns."""

from __future__ import annotations

import pytest
from degenerate import write

from tallyloom.llm import queries


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q.endswith("_found")])
def test_problem_queries(spark, sf_dir, tmp_path, kind, name):
    folder = write(sf_dir, str(tmp_path), kind)
    n = queries.QUERIES[name](spark, folder).count()
    if kind == "empty":
        assert n == 0
    else:
        assert n >= queries.QUERIES[name](spark, sf_dir).count()
