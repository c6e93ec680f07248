"""Registered queries: name → (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewell.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")

            @wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(spark, sf_dir)

            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return f

        return put
