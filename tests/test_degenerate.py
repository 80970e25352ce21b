"""Problem queries of the core over empty tables and over tables with null rows and clashing columns."""

from __future__ import annotations

import pytest
from degenerate import write
from oracle import check, views

from tallyloom.plans import training


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_problem_queries(spark, sf_dir, tmp_path, kind):
    folder = write(sf_dir, str(tmp_path), kind)
    con = views(folder)
    for name, query in training.QUERIES.items():
        if kind == "empty":
            assert query(spark, folder).count() == 0, name
        else:
            skip = name in ("p3_card_totals", "p3_format_totals")  # the tie rule of nulls is ours alone
            check(spark, con, folder, query, None if skip or name.startswith("p1") else training.ORACLE.get(name))
