"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklake.plans._registry import Registry, table
from sparklake.session import scratch_path
from sparklake.sources import files

QUERIES = Registry()
add = QUERIES.add


@add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity > 45")
def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1997-01-01' AND l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@add("SELECT range AS id, range % 7 AS bucket FROM range(10, 1000)")
def range_gen(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(10, 1000).withColumn("bucket", F.col("id") % 7)


@add("SELECT * FROM (VALUES (1, 'US', 'ok', 10.5::DOUBLE), (2, 'DE', NULL, 3.25), (3, 'FR', 'bad', -1.0)) t(order_id, country, status, amount)")
def inline_values(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(1, "US", "ok", 10.5), (2, "DE", None, 3.25), (3, "FR", "bad", -1.0)], "order_id int, country string, status string, amount double")


@add("SELECT NULL::VARCHAR AS order_id, NULL::DOUBLE AS amount, NULL::DATE AS order_date WHERE FALSE")
def empty_typed(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([], "order_id string, amount double, order_date date")


def _round_trip(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_path(spark, kind)
        orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
        files.write(orders, path, kind)
        return files.read(spark, path, kind, orders.schema).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))

    return run


for _kind in ("csv", "json", "orc", "parquet", "xml"):
    QUERIES.add("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DECIMAL(18,2)::DOUBLE AS o_totalprice FROM orders", f"{_kind}_roundtrip")(_round_trip(_kind))


@add("SELECT 'a,1' AS raw, 1::INTEGER AS n, 'good' AS kind UNION ALL SELECT 'b,x', NULL, 'bad' UNION ALL SELECT 'c,3', 3, 'good'")
def malformed_records(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.createDataFrame([("a,1",), ("b,x",), ("c,3",)], "value string")
    parsed = files.parse_csv(lines, "name string, n int")
    return parsed.select("raw", "n", F.when(F.col("bad"), "bad").otherwise("good").alias("kind"))


@add("SELECT count(*) AS n_lines, sum(strlen(text))::BIGINT AS n_bytes FROM benchmark")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "text")
    table(spark, sf, "benchmark").select(F.col("text").alias("value")).write.option("lineSep", "\x1e").text(path)
    return spark.read.option("lineSep", "\x1e").text(path).agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("value")).alias("n_bytes"))


@add("SELECT count(*) AS n_files, 5::BIGINT AS n_rows FROM range(1)")
def whole_text_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "whole")
    table(spark, sf, "region").select("r_name").coalesce(1).write.text(path)
    whole = spark.read.text(path, wholetext=True)
    return whole.agg(F.count("*").alias("n_files"), F.sum(F.regexp_count("value", F.lit("\n"))).cast("long").alias("n_rows"))


@add("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def partition_discovery(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "parts")
    files.write(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path, "parquet", partition_by=("o_orderstatus",))
    return spark.read.parquet(path).where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@add("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def glob_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "glob")
    files.write(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path, "parquet", partition_by=("o_orderstatus",))
    return spark.read.option("pathGlobFilter", "*.parquet").option("basePath", path).parquet(f"{path}/o_orderstatus=[F]").agg(F.count("*").alias("n"))


@add("SELECT r_regionkey AS id, r_name AS name, NULL::VARCHAR AS email FROM region UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def merge_schema(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "merged")
    table(spark, sf, "region").selectExpr("r_regionkey AS id", "r_name AS name").write.parquet(f"{path}/v=1")
    table(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_name AS email").write.parquet(f"{path}/v=2")
    return spark.read.option("mergeSchema", True).parquet(path).select("id", "name", "email")


@add("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def table_scan(spark: SparkSession, sf: str) -> DataFrame:
    name = files.save_table(table(spark, sf, "nation"), "scan")
    return spark.table(name).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@add("SELECT n_nationkey, 'parquet' AS kind FROM nation")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", F.regexp_extract(F.input_file_name(), r"\.(\w+)$", 1).alias("kind"))


@add("SELECT 'append' AS mode, 10::BIGINT AS n UNION ALL SELECT 'overwrite', 5 UNION ALL SELECT 'ignore', 5 UNION ALL SELECT 'error', 5")
def save_modes(spark: SparkSession, sf: str) -> DataFrame:
    region, found = table(spark, sf, "region"), []
    for mode in ("append", "overwrite", "ignore", "error"):
        path = scratch_path(spark, mode)
        region.write.parquet(path)
        files.write_again(region, path, mode)
        found.append(spark.read.parquet(path).agg(F.lit(mode).alias("mode"), F.count("*").alias("n")))
    return found[0].union(found[1]).union(found[2]).union(found[3])


@add("SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS least FROM orders GROUP BY 1")
def partitioned_write(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "by-priority")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    files.write(orders.repartition("o_orderpriority"), path, "parquet", partition_by=("o_orderpriority",))
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


@add("SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE count(*) END AS n FROM orders GROUP BY 1")
def dynamic_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "dynamic")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    files.write(orders, path, "parquet", partition_by=("o_orderstatus",))
    files.overwrite_partitions(spark.createDataFrame([(1, "F")], "o_orderkey long, o_orderstatus string"), path, ("o_orderstatus",))
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@add("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def bucketed_join(spark: SparkSession, sf: str) -> DataFrame:
    left = files.save_table(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "bc", bucket=(8, "c_custkey"))
    right = files.save_table(table(spark, sf, "orders").select("o_custkey", "o_totalprice"), "bo", bucket=(8, "o_custkey"))
    joined = spark.table(left).join(spark.table(right), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@add("SELECT TRUE AS managed_gone, 25::BIGINT AS external_rows")
def managed_and_external(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "external")
    nation = table(spark, sf, "nation")
    managed, external = files.save_table(nation, "managed"), files.save_table(nation, "external", path=path)
    spark.sql(f"DROP TABLE {managed}")
    spark.sql(f"DROP TABLE {external}")
    return spark.read.parquet(path).agg(F.lit(not spark.catalog.tableExists(managed)).alias("managed_gone"), F.count("*").alias("external_rows"))


@add("SELECT 8::BIGINT AS scattered_at_least, 1::BIGINT AS clustered_each, 5::BIGINT AS keys")
def small_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a partitioned write, dealt at random and by key: the latter has one for each key."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    scattered, clustered = scratch_path(spark, "scattered"), scratch_path(spark, "clustered")
    orders.repartition(8).write.partitionBy("o_orderpriority").parquet(scattered)
    orders.repartition(8, "o_orderpriority").write.partitionBy("o_orderpriority").parquet(clustered)
    a, b = files.file_counts(spark, scattered, "o_orderpriority"), files.file_counts(spark, clustered, "o_orderpriority")
    both = a.join(b.withColumnRenamed("n_files", "m_files"), "o_orderpriority")
    return both.agg(F.min("n_files").alias("scattered_at_least"), F.max("m_files").alias("clustered_each"), F.count("*").alias("keys"))


@add("SELECT 'count' AS summary, count(l_quantity)::VARCHAR AS l_quantity FROM lineitem UNION ALL SELECT 'min', min(l_quantity)::VARCHAR FROM lineitem UNION ALL SELECT 'max', max(l_quantity)::VARCHAR FROM lineitem")
def describe_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_quantity").summary("count", "min", "max")


@add("SELECT range AS id, CASE WHEN range % 10 < 8 THEN 999 ELSE range % 100 END AS user_id, ['view', 'click', 'buy'][range % 3 + 1] AS kind FROM range(1000)")
def generated_skew(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("view", "click", "buy")))
    user = F.when(F.col("id") % 10 < 8, F.lit(999)).otherwise(F.col("id") % 100)
    return spark.range(1000).select("id", user.cast("long").alias("user_id"), F.element_at(kinds, (F.col("id") % 3 + 1).cast("int")).alias("kind"))
