"""How the plan modules name their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seamark.session import table


class Tables:
    """The driver's tables by attribute: ``Tables(spark, dir).documents``."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.dir = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)


class Plans:
    """Collects queries; ``@plans.query(name, sql)`` registers a function of ``Tables``."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, d: f(Tables(spark, d))
            if sql:
                self.sql[name] = sql
            return f

        return add
