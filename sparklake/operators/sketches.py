"""Sketches as DataFrames: built in one pass with partial sums before the shuffle, merged by adding, of a size that doesn't grow with the input."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _slot(value: str | Column, row: int | Column, width: int) -> Column:
    """By the value as text, so equal numbers of different types share their slots."""
    row = F.lit(row) if isinstance(row, int) else row
    return F.pmod(F.xxhash64(row, (F.col(value) if isinstance(value, str) else value).cast("string")), F.lit(width))


def count_min(df: DataFrame, column: str, width: int = 4096, depth: int = 4) -> DataFrame:
    """(row, slot, n): ``depth`` rows of at most ``width`` counters. Nulls count nothing."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row"))
    return rows.groupBy("row", _slot("v", F.col("row"), width).alias("slot")).agg(F.count("*").alias("n"))


def count_min_merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows of sketches of the same width and depth."""
    both = sketches[0]
    for s in sketches[1:]:
        both = both.unionByName(s)
    return both.groupBy("row", "slot").agg(F.sum("n").alias("n"))


def count_min_estimate(sketch: DataFrame, values: DataFrame, column: str, width: int = 4096, depth: int = 4) -> DataFrame:
    """values with ``estimate``: never under the count, and over it by at most 2.72 / width of all rows in all but e**-depth of cases."""
    asked = values.select(F.struct(*values.columns).alias("_row"), F.col(column).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row"))
    found = asked.withColumn("slot", _slot("v", F.col("row"), width)).join(F.broadcast(sketch), ["row", "slot"], "left")  # width * depth rows
    least = found.groupBy("_row").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
    return least.select("_row.*", "estimate")


def bloom(df: DataFrame, column: str, expected: int, rate: float = 0.01, most_bits: int = 1 << 26) -> tuple[DataFrame, int, int]:
    """((word, bits), number of bits, hashes): a Bloom filter of the column's values as 64-bit words, of at most ``most_bits``."""
    bits = min(most_bits, max(64, math.ceil(-expected * math.log(rate) / math.log(2) ** 2)))
    hashes = max(1, round(bits / max(expected, 1) * math.log(2)))
    at = df.where(F.col(column).isNotNull()).select(F.explode(F.array(*[_slot(column, k, bits) for k in range(hashes)])).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(at, 64) AS INT))")).alias("bits"))
    return words, bits, hashes


def bloom_filter(df: DataFrame, column: str, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Rows of df whose value may be in the filter: all that are, and a few others."""
    numbered = df.select(F.struct(*df.columns).alias("_row"), F.col(column).alias("_v"), F.monotonically_increasing_id().alias("_id"))
    at = [F.struct(F.floor(_slot("_v", k, bits) / 64).alias("word"), F.pmod(_slot("_v", k, bits), F.lit(64)).cast("int").alias("bit")) for k in range(hashes)]
    asked = numbered.select("_row", "_id", F.explode(F.array(*at)).alias("p"))
    met = asked.join(F.broadcast(words), F.col("p.word") == F.col("word"))  # at most most_bits / 64 rows
    hit = met.where(F.getbit("bits", "p.bit") == 1)
    return hit.groupBy("_id").agg(F.first("_row").alias("_row"), F.count("*").alias("n")).where(F.col("n") == hashes).select("_row.*")


def reservoir(df: DataFrame, keys: list[str], size: int, seed: int = 42) -> DataFrame:
    """A uniform sample of ``size`` rows: those whose hashed ``keys`` (which tell rows apart) come first. Merging samples of parts gives that of the whole."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(size)


def heavy_hitters(df: DataFrame, column: str, k: int, slots: int = 4096) -> DataFrame:
    """(column, n): the k most frequent values with exact counts, ties by value.

    One pass counts hashed slots; a value that is among the first k is in a slot with at least the k-th value's count, so the second pass only counts values of
    slots whose sum reaches the k-th largest of any lower bound: the counts of the values of the k fullest slots.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), _slot(column, 0, slots).alias("slot"))
    sums = rows.groupBy("slot").agg(F.count("*").alias("total"))
    fullest = sums.orderBy(F.desc("total"), "slot").limit(k)
    first = rows.join(F.broadcast(fullest.select("slot")), "slot").groupBy("v").agg(F.count("*").alias("n"))
    least = first.orderBy(F.desc("n"), "v").limit(k).agg(F.when(F.count("*") == k, F.min("n")).otherwise(0).alias("least"))
    may = sums.join(F.broadcast(least)).where("total >= least").select("slot")
    counts = rows.join(F.broadcast(may), "slot").groupBy("v").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "v").limit(k).select(F.col("v").alias(column), "n")
