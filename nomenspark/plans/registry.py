"""How the modules of queries register them."""

from __future__ import annotations

from nomenspark import corpus


class Registry:
    def __init__(self) -> None:
        self.queries, self.oracle = {}, {}

    def __call__(self, name: str, sql: str | None = None, *tables: str):
        """Registers a query and its oracle; tables: the derived tables that the SQL reads."""

        def put(f):
            self.queries[name] = f
            if sql:
                self.oracle[name] = (corpus.with_tables(*tables) if tables else "") + sql
            return f

        return put
