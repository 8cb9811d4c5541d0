"""A query is a function of (spark, sf_dir) and, where DuckDB can express it, the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Registry(dict):
    def add(self, sql: str | None = None, name: str | None = None):
        def register(f):
            self[name or f.__name__] = Query(f, sql)
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(array: Column) -> Column:
    """An array as text, for results that are compared between engines."""
    return F.array_join(array.cast("array<string>"), ",")
