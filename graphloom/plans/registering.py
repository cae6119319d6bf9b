"""Queries by name with their SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        """Register a function of (spark, sf_dir); without SQL where SQL can't express it or is too slow on whole tables."""

        def keep(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
