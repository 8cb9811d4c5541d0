"""What Spark says about plans, partitions and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The modes of EXPLAIN.
MODES = ("simple", "extended", "codegen", "cost", "formatted")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What ``explain(mode)`` prints."""
    if mode not in MODES:
        raise ValueError(f"modes are {', '.join(MODES)}")
    kind = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(kind)


def runtime_settings(spark: SparkSession, *keys: str) -> dict[str, bool]:
    """Whether each setting can be changed while the session runs; the others are fixed when the application starts."""
    return {k: spark.conf.isModifiable(k) for k in keys}


def partition_sizes(df: DataFrame) -> list[int]:
    """Rows of each partition, counted where they are."""
    return df.rdd.mapPartitionsWithIndex(lambda i, rows: [(i, sum(1 for _ in rows))]).sortByKey().values().collect()


def lineage(df: DataFrame) -> str:
    """The RDD lineage below a DataFrame."""
    return df.rdd.toDebugString().decode()
