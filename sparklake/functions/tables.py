"""Table functions, and functions with values that the driver hands out or gathers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="position int, word string")
class SplitWords:
    """A row for each word of a text, numbered from 1."""

    def eval(self, text: str):
        for k, word in enumerate((text or "").split(), 1):
            yield k, word


def lookup(spark: SparkSession, values: dict, returns: str = "string"):
    """A function that maps a column by a broadcast dictionary; for tables of any size a join with a broadcast hint is the plain way."""
    held = spark.sparkContext.broadcast(values)

    def run(a: pd.Series) -> pd.Series:
        return a.map(held.value)

    return F.pandas_udf(run, returns)


def counted_rows(df: DataFrame, test) -> tuple[int, int]:
    """(rows, rows for which ``test`` holds) by accumulators of one action. Retried tasks count again, so this is for monitoring, not for results."""
    context = df.sparkSession.sparkContext
    total, held = context.accumulator(0), context.accumulator(0)

    def run(rows: Iterator) -> None:
        for row in rows:
            total.add(1)
            if test(row):
                held.add(1)

    df.foreachPartition(run)
    return total.value, held.value
