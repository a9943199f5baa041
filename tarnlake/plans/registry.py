"""Named queries: a Spark function and, where SQL can say it, the same result as portable SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tarnlake.session import bound_tasks


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def guarded(fn):
    """Queries run in the caller's session: the bounds of a task hold there too."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_tasks(spark)
        return fn(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(guarded(fn), sql.strip() if sql else None)
        return fn

    return add
