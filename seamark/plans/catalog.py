"""The registry of queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seamark.plans import accounts, assemblies, composites, evolving, relations, retrieval, storage, texts

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (storage, retrieval, relations, accounts, texts, composites, assemblies)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out |= m.plans.queries
    return out | evolving.QUERIES


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.plans.sql
    return out | evolving.ORACLE
