"""Collects registered queries and the SQL of their answers."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.queries, self.sql = {}, {}

    def __call__(self, key: str, sql: str | None = None):
        def register(f):
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = sql
            return f

        return register
