"""Registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[QueryFn], QueryFn]:
        """Decorator: register a query under its function's name; without SQL only its rows can be compared in tests."""

        def wrap(fn: QueryFn) -> QueryFn:
            key = name or fn.__name__
            self.queries[key] = fn
            if sql:
                self.sql[key] = sql
            return fn

        return wrap
