"""Range joins, as-of joins and sessions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Inner join where lo <= at <= hi (numbers), besides equal ``keys``: ranges are listed under every bucket of ``width`` they
    meet, a point lies in exactly one, so it becomes an equi-join without duplicates. Nulls match nothing. Choose ``width`` near
    the usual length of a range.
    """
    buckets = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    listed = ranges.where(F.col(lo) <= F.col(hi)).withColumn("_b", F.explode(buckets))
    return points.withColumn("_b", F.floor(F.col(at) / width)).join(listed, [*keys, "_b"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_b")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: tuple[str, ...], slices: str | None = None) -> DataFrame:
    """Each left row with ``values`` and ``right_at`` of the latest right row of its key at or before it (null if there is none).

    One shuffle and sort of both sides together. Of right rows with equal key and time the greatest values win. Null keys match nothing.
    For hot keys, ``slices`` is a monotonic SQL expression of the time ``_t`` (say ``date_trunc('day', _t)``): a key is then sorted in
    slices, each of which starts from the last right row of the slices before it, found on one row for each key and slice.
    """
    held = F.struct(F.col(right_at).alias("at"), *values)
    a = left.select(F.col(key).alias("_k"), F.col(left_at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    b = right.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), held.alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_s", F.expr(slices) if slices else F.lit(0))
    w = Window.partitionBy("_k", "_s").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if slices:
        ends = b.withColumn("_s", F.expr(slices)).groupBy("_k", "_s").agg(F.max_by("_r", F.struct("_t", "_r")).alias("_last"))
        needed = ends.unionByName(both.where("_side = 1").select("_k", "_s").distinct(), allowMissingColumns=True).groupBy("_k", "_s").agg(F.max("_last").alias("_last"))
        before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        carried = needed.withColumn("_c", F.last("_last", ignorenulls=True).over(before)).where("_c IS NOT NULL").select("_k", "_s", "_c")
        found = found.join(carried, ["_k", "_s"], "left").withColumn("_r", F.coalesce("_r", "_c"))
    return found.select("_l.*", F.col("_r.at").alias(right_at), *[F.col(f"_r.{v}").alias(v) for v in values])


def point_in_time_join(facts: DataFrame, history: DataFrame, key: str, at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Facts with the history row valid at that time: start <= at < end, a null end is open."""
    valid = (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return facts.join(history, key).where(valid)


def sessionize(df: DataFrame, key: str, at: str, gap_seconds: int, tie: str) -> DataFrame:
    """df with session (1, 2, ... for each key): a new one starts after more than ``gap_seconds``; an equal gap stays. ``tie`` orders equal times."""
    w = Window.partitionBy(key).orderBy(at, tie)
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    gap = seconds - F.lag(seconds).over(w)
    starts = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    return df.withColumn("_s", starts).withColumn("session", F.sum("_s").over(w)).drop("_s")


def exponential_mean(df: DataFrame, key: str, order: list[str], value: str, alpha: float, name: str = "ewm", slices: str | None = None) -> DataFrame:
    """df with the exponentially weighted mean so far: m = alpha * value + (1 - alpha) * m before, from the first value on. Null values keep m.

    With d = 1 - alpha, the n-th value's mean is a sum of value * d**-j over the values so far, times d**n. Values are
    numbered in blocks in which d**-j stays below 1e200, so running sums serve; what came before the last block weighs less than a double
    can tell. Linear in a key's rows. For hot keys, ``slices`` is a monotonic SQL expression of the first ``order`` column ``_t`` (say
    ``date_trunc('day', _t)``): a key is then sorted in slices, and sums are carried on one row for each key, slice and block.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    decay = 1 - alpha
    block = max(1, int(math.log(1e-200) / math.log(decay)))
    held = df.select(F.struct(*df.columns).alias("_row"), F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"), F.col(order[0]).alias("_t"), F.struct(*order).alias("_o"))
    held = held.withColumn("_s", F.expr(slices) if slices else F.lit(0))
    by_slice = held.groupBy("_k", "_s").agg(F.count("_v").alias("_c"), F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_o"))).alias("_x"))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    # values of the key before the slice, and the key's first value
    starts = by_slice.select(F.col("_k").alias("_k2"), F.col("_s").alias("_s2"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_n0"), F.first("_x", ignorenulls=True).over(upto).alias("_x0"))
    placed = held.join(starts, F.col("_k").eqNullSafe(F.col("_k2")) & F.col("_s").eqNullSafe(F.col("_s2"))).drop("_k2", "_s2")
    running = Window.partitionBy("_k", "_s").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_n", F.col("_n0") + F.count("_v").over(running))
    # a null behind a block's last value belongs to that block
    placed = placed.withColumns({"_b": F.floor(F.greatest(F.col("_n") - 1, F.lit(0)) / block), "_j": F.pmod(F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(block))})
    placed = placed.withColumn("_w", F.col("_v") * F.pow(F.lit(decay), -F.col("_j")))
    in_block = Window.partitionBy("_k", "_s", "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_sum", F.coalesce(F.sum("_w").over(in_block), F.lit(0.0)))
    parts = placed.groupBy("_k", "_b", "_s").agg(F.sum("_w").alias("_p"))
    earlier = Window.partitionBy("_k", "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_p").over(earlier), F.lit(0.0)))
    whole = parts.groupBy("_k", "_b").agg(F.sum("_p").alias("_total")).withColumn("_last", F.lag("_total").over(Window.partitionBy("_k").orderBy("_b")))
    parts = parts.join(whole.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), "_last"), F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_b") == F.col("_b2")))
    parts = parts.select(F.col("_k").alias("_k2"), F.col("_s").alias("_s2"), F.col("_b").alias("_b2"), "_before", "_last")
    on = F.col("_k").eqNullSafe(F.col("_k2")) & F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2"))
    found = placed.join(parts, on)
    # the mean before a block: the first value stands before the first
    end = alpha * F.pow(F.lit(decay), F.lit(block - 1)) * F.col("_last")
    end = F.when(F.col("_b") == 1, end + F.pow(F.lit(decay), F.lit(block)) * F.col("_x0")).otherwise(end)
    carried = F.when(F.col("_b") == 0, F.col("_x0")).otherwise(end)
    mean = alpha * F.pow(F.lit(decay), F.col("_j")) * (F.col("_sum") + F.col("_before")) + F.pow(F.lit(decay), F.col("_j") + 1) * carried
    return found.select("_row.*", F.when(F.col("_n") > 0, mean).alias(name))
