"""Named queries with their SQL for comparison; one module per area."""

from __future__ import annotations

import importlib

#: Modules of this package that define QUERIES and ORACLE.
AREAS = ["training", "baskets", "maintenance", "chances", "surface", "names", "catalogue", "answers"]


def registered() -> tuple[dict, dict]:
    queries: dict = {}
    oracle: dict = {}
    for area in AREAS:
        module = importlib.import_module(f"tallyloom.plans.{area}")
        twice = queries.keys() & module.QUERIES.keys()
        if twice:
            raise ValueError(f"queries defined twice: {sorted(twice)}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
