"""Joins and aggregations over skewed keys. Salts hash row keys, so a retried task deals its rows the same way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salt(n: int, *keys: str) -> Column:
    """0 to n - 1 by the hash of ``keys``, which should tell rows apart."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key, counted before the shuffle."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def hot_keys(df: DataFrame, key: str, share: float = 0.05) -> DataFrame:
    """Keys that hold at least ``share`` of all rows: at most 1 / share of them, which bounds a broadcast. Null counts as a key."""
    counts = key_counts(df, key)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).where(F.col("n") >= F.col("total") * share).select(key)


def salted_join(big: DataFrame, small: DataFrame, key: str, row_keys: tuple[str, ...], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join with every key of ``big`` dealt over ``salts`` tasks and ``small`` repeated for each; how: inner, left, left_semi, left_anti."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join can't keep unmatched rows of the repeated side: {how}")
    left = big.withColumn("_salt", salt(salts, *row_keys))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def selective_salted_join(big: DataFrame, small: DataFrame, key: str, row_keys: tuple[str, ...], hot: DataFrame | None = None, salts: int = 16, how: str = "inner") -> DataFrame:
    """Like ``salted_join``, but only hot keys are dealt and repeated; the others keep salt 0."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join can't keep unmatched rows of the repeated side: {how}")
    hot = F.broadcast((hot_keys(big, key) if hot is None else hot).select(F.col(key), F.lit(True).alias("_hot")))
    left = big.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), salt(salts, *row_keys)).otherwise(0)).drop("_hot")
    copies = F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(0))
    right = small.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


#: Rows of ``small`` with a hot key that ``hot_split_join`` broadcasts, at most.
BROADCAST_ROWS = 100_000


def hot_split_join(big: DataFrame, small: DataFrame, key: str, row_keys: tuple[str, ...], hot: DataFrame | None = None, salts: int = 16) -> DataFrame:
    """Inner join with hot keys taken apart: their rows of ``small`` are broadcast if they are counted to be at most ``BROADCAST_ROWS``, else the hot part
    is a salted join; the rest is shuffled."""
    hot = F.broadcast(hot_keys(big, key) if hot is None else hot)
    big_hot, small_hot = big.join(hot, key, "left_semi"), small.join(hot, key, "left_semi")
    few = small_hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    at_hot = big_hot.join(F.broadcast(small_hot), key) if few else salted_join(big_hot, small_hot, key, row_keys, salts)
    return at_hot.unionByName(big.join(hot, key, "left_anti").join(small, key))


def two_pass_aggregate(df: DataFrame, keys: list[str], row_keys: tuple[str, ...], sums: dict[str, str], salts: int = 16) -> DataFrame:
    """(keys, n, sums): partial counts and sums for each key and salt, then for each key. sums: output name to input column."""
    partial = df.groupBy(*keys, salt(salts, *row_keys).alias("_salt")).agg(F.count("*").alias("n"), *[F.sum(c).alias(o) for o, c in sums.items()])
    return partial.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(o).alias(o) for o in sums])
