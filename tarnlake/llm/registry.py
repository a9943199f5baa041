"""Queries of this subpackage, kept apart from those of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnlake.plans.registry import Query, guarded

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(guarded(fn), sql.strip() if sql else None)
        return fn

    return add
