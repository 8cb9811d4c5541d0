"""Slowly changing dimensions of types 1, 2, 3, 4 and 6 as DataFrame builders, and type 2 as a MERGE on a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklake.operators.dedup import content_hash
from sparklake.table import VersionedTable


def type1(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Overwrite: updates replace rows of their key."""
    return current.join(updates.select(key), key, "left_anti").unionByName(updates)


def type2(changes: DataFrame, key: str, at: str, attributes: list[str]) -> DataFrame:
    """History from all changes, in any order of arrival: valid_from, valid_to (null: open), is_current.

    Repeated states are merged into one interval; of two changes at the same time the greater values win.
    """
    by_key = Window.partitionBy(key).orderBy(at)
    one = changes.groupBy(key, at).agg(F.max(F.struct(*attributes)).alias("_a"))
    new = one.withColumn("_before", F.lag("_a").over(by_key)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_a")))
    end = F.lead(at).over(by_key)
    return new.select(key, "_a.*", F.col(at).alias("valid_from"), end.alias("valid_to"), end.isNull().alias("is_current"))


def type3(current: DataFrame, updates: DataFrame, key: str, attribute: str) -> DataFrame:
    """current with ``attribute`` updated and its last value in previous_<attribute>."""
    new = updates.select(key, F.col(attribute).alias("_new"), F.lit(True).alias("_hit"))
    joined = current.join(new, key, "left")
    moved = F.coalesce(F.col("_hit"), F.lit(False)) & ~F.col(attribute).eqNullSafe(F.col("_new"))
    return joined.withColumn(f"previous_{attribute}", F.when(moved, F.col(attribute))).withColumn(attribute, F.when(moved, F.col("_new")).otherwise(F.col(attribute))).drop("_new", "_hit")


def type4(changes: DataFrame, key: str, at: str, attributes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(current rows, history table)."""
    history = type2(changes, key, at, attributes)
    return history.where("is_current").select(key, *attributes), history


def type6(changes: DataFrame, key: str, at: str, attributes: list[str]) -> DataFrame:
    """Type 2 history that also carries each attribute's current value in current_<attribute>."""
    history = type2(changes, key, at, attributes)
    now = history.where("is_current").select(key, *[F.col(a).alias(f"current_{a}") for a in attributes])
    return history.join(now, key)


def history_table(spark, path: str, key: str, updates: DataFrame, attributes: list[str], at: str) -> VersionedTable:
    """An empty type 2 table for such updates."""
    kinds = dict(updates.dtypes)
    columns = [f"{key} {kinds[key]}", *(f"{a} {kinds[a]}" for a in attributes), f"valid_from {kinds[at]}", f"valid_to {kinds[at]}", "is_current boolean", "attr_hash string"]
    return VersionedTable.create(spark, path, ", ".join(columns))


def apply_type2(table: VersionedTable, updates: DataFrame, key: str, at: str, attributes: list[str]) -> int:
    """Apply a batch of changes in one MERGE, in any order of arrival: a late change splits the interval that it falls into.

    The histories of the updates' keys are built anew from their stored intervals and the updates; of two states of a key at one time the greater
    values win. A replay changes nothing. Rows with a null key or time are left out. The table keeps changes only: a repeat of the state that holds leaves
    no trace, so a different state that arrives later, from before that repeat, holds until the next change.
    """
    updates = updates.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, *attributes)
    stored = table.to_df().join(updates.select(key).distinct(), key, "left_semi")
    states = stored.select(key, F.col("valid_from").alias(at), *attributes).unionByName(updates)
    new = type2(states, key, at, attributes).withColumn("attr_hash", content_hash(*attributes))
    columns = [key, *attributes, "valid_from", "valid_to", "is_current", "attr_hash"]
    gone = stored.join(new.select(key, "valid_from"), [key, "valid_from"], "left_anti")
    source = new.select(*columns).withColumn("_gone", F.lit(False)).unionByName(gone.select(*columns).withColumn("_gone", F.lit(True)))
    merge = table.merge(source, f"t.`{key}` = s.`{key}` AND t.valid_from = s.valid_from")
    values = {c: f"s.`{c}`" for c in columns}
    differs = "NOT (t.attr_hash <=> s.attr_hash AND t.valid_to <=> s.valid_to AND t.is_current <=> s.is_current)"
    return merge.when_matched_delete("s._gone").when_matched_update(values, differs).when_not_matched_insert(values).execute()
