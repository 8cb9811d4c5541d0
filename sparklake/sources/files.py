"""File sources and sinks over Spark's own readers and writers, with explicit schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Options that make a round trip lossless; other options can be passed on top.
_READ = {"csv": {"header": "true", "mode": "FAILFAST"}, "json": {"mode": "FAILFAST"}, "xml": {"rowTag": "row"}}
_WRITE = {"csv": {"header": "true"}, "xml": {"rowTag": "row", "rootTag": "rows"}}
#: Sources whose connector is a separate package: their options pass through unchanged.
CONNECTORS = ("avro", "kafka", "jdbc")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options) -> DataFrame:
    """A file source with an explicit schema (inference costs a second scan)."""
    reader = spark.read.format(kind).options(**_READ.get(kind, {})).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**_WRITE.get(kind, {})).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_again(df: DataFrame, path: str, mode: str) -> bool:
    """Write to a path that may exist; False if ``error`` mode refused."""
    from pyspark.errors import AnalysisException

    try:
        df.write.mode(mode).parquet(path)
    except AnalysisException:
        if mode not in ("error", "errorifexists"):
            raise
        return False
    return True


def overwrite_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Replace only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def parse_csv(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Permissive parsing that keeps the raw line: raw, the fields (null where malformed) and whether the line is bad."""
    parsed = F.from_csv(F.col(column), F.lit(f"{schema}, _bad string"), {"columnNameOfCorruptRecord": "_bad"})
    found = lines.select(F.col(column).alias("raw"), parsed.alias("p")).select("raw", "p.*")
    return found.withColumn("bad", F.col("_bad").isNotNull()).drop("_bad")


def save_table(df: DataFrame, prefix: str, path: str | None = None, bucket: tuple | None = None) -> str:
    """A catalog table under a fresh name: managed, or external at ``path``; ``bucket`` is (number, *columns), sorted likewise."""
    name = f"{prefix}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet")
    if bucket:
        writer = writer.bucketBy(bucket[0], *bucket[1:]).sortBy(*bucket[1:])
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return name


def file_counts(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """How many files hold rows of each partition."""
    return spark.read.parquet(path).select(*keys, F.input_file_name().alias("f")).distinct().groupBy(*keys).agg(F.count("*").alias("n_files"))
