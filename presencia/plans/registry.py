"""Collects queries and their SQL under one name each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries, each with the SQL that must give the same rows where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function under ``name``."""

        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is taken")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
