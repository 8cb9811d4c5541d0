"""Deduplication by key and by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklake.operators.skew import salt


def any_row(df: DataFrame, *keys: str) -> DataFrame:
    """One arbitrary row of each key."""
    return df.dropDuplicates(list(keys))


def latest(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in ``order``, which should be total (end it with a tie-break)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_salted(df: DataFrame, keys: list[str], row_keys: tuple[str, ...], *order: Column | str, salts: int = 16) -> DataFrame:
    """As ``latest``, for hot keys: the first of each key and salt, then of each key."""
    w = Window.partitionBy(*keys, "_salt").orderBy(*order)
    some = df.withColumn("_salt", salt(salts, *row_keys)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_salt")
    return latest(some, keys, *order)


def latest_by_aggregate(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the greatest ``order`` of each key, combined before the shuffle: hot keys need no salt."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def content_hash(*columns: str) -> Column:
    """SHA-256 of the values as JSON, nulls kept apart: (a, null, b) and (a, b, null) differ."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def unseen(df: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't in ``seen``; Spark may prune with a run-time Bloom filter. Rows with a null key stay."""
    return df.join(seen.select(*keys), list(keys), "left_anti")
