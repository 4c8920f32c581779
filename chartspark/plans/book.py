"""A small book of named queries."""

from __future__ import annotations

from collections.abc import Callable


class PlanBook:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        """Register the decorated (spark, sf_dir) function; sql is its DuckDB twin."""

        def keep(query: Callable) -> Callable:
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql
            return query

        return keep
