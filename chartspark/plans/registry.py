"""Collects the queries and SQL twins of all plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ["chart", "dataset", "profile", "quality", "lyrics", "matching", "titles", "frames", "statistics", "modelling", "files"]


def _modules():
    for name in MODULES:
        yield importlib.import_module(f"chartspark.plans.{name}")


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for module in _modules():
        for name, query in module.PLANS.queries.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = query
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found.update(module.PLANS.oracles)
    return found
