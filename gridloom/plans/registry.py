"""Queries by name, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects the queries of one module."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            key = name or fn.__name__
            self.queries[key] = fn
            if sql is not None:
                self.sql[key] = sql
            return fn

        return keep
