"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Registers a function (spark, sf_dir) under its name."""

        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add

    def also(self, name: str, of: str) -> None:
        """Another name of a query; earlier versions gave it a part of the tables or texts only."""
        self.queries[name] = self.queries[of]
        if of in self.sql:
            self.sql[name] = self.sql[of]
