"""The orders pipeline: raw lines, typed and deduplicated orders with a dead letter, and daily revenue."""

from __future__ import annotations

import argparse
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklake.operators.dedup import latest
from sparklake.session import get_session, materialise
from sparklake.table import VersionedTable

#: The orders' fields and the layers' columns.
ORDER = "order_id string, customer_id string, sku string, amount decimal(18,2), region string, order_time timestamp"
BRONZE = "raw_value string, source_file string, batch_date date, batch_id string"
SILVER = f"{ORDER}, order_date date, batch_id string"
#: An order without one of these is bad.
REQUIRED = ("order_id", "customer_id", "sku", "amount", "order_time")


@dataclass(frozen=True)
class Config:
    """A job's settings: where the layers are, in a folder for each environment, and what is loaded."""

    root: str
    env: str | None = None
    source: str | None = None
    batch_date: str | None = None
    batch_id: str = "manual"

    def table(self, name: str) -> str:
        return "/".join(x for x in (self.root, self.env, name) if x)

    @classmethod
    def from_args(cls, args: list[str] | None = None) -> Config:
        """From command line arguments; environment and date are checked."""
        parser = argparse.ArgumentParser(description="Load a day of orders into bronze and silver.")
        parser.add_argument("--root", required=True)
        parser.add_argument("--env", choices=("dev", "staging", "prod"), default="dev")
        parser.add_argument("--source", required=True)
        parser.add_argument("--batch-date", required=True, type=lambda x: dt.date.fromisoformat(x).isoformat())
        parser.add_argument("--batch-id", default="manual")
        return cls(**vars(parser.parse_args(args)))


def main(args: list[str] | None = None) -> None:
    """The job: ``python -m sparklake.pipelines.orders --root ... --source ... --batch-date 2024-01-01``."""
    config = Config.from_args(args)
    spark = get_session(f"orders-{config.env}")
    ingest_bronze(spark, config, config.source, config.batch_date, config.batch_id)
    build_silver(spark, config, config.batch_date)


def ingest_bronze(spark: SparkSession, config: Config, source: str, batch_date: str, batch_id: str) -> VersionedTable:
    """Raw JSON lines with provenance; a rerun of a day replaces that day."""
    path = config.table("bronze")
    table = VersionedTable(spark, path)
    if table.version < 0:
        table = VersionedTable.create(spark, path, BRONZE, ("batch_date",))
    raw = spark.read.text(source).select(F.col("value").alias("raw_value"), F.input_file_name().alias("source_file"), F.lit(batch_date).cast("date").alias("batch_date"), F.lit(batch_id).alias("batch_id"))
    table.replace_where(raw, f"batch_date = DATE '{batch_date}'")
    return table


def parse(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good orders, dead letter with a reason). Malformed JSON parses to nulls, so required fields decide."""
    # a generator, so each line is parsed once however many fields and filters use it
    parsed = bronze.select("raw_value", "source_file", "batch_id", F.inline_outer(F.array(F.from_json("raw_value", ORDER))))
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in REQUIRED], F.when(F.col("amount") <= 0, F.lit("amount not positive")))
    marked = parsed.withColumn("reason", missing)
    good = marked.where("reason = ''").drop("reason", "raw_value", "source_file").withColumn("order_date", F.to_date("order_time"))
    return good, marked.where("reason <> ''").select("raw_value", "source_file", "batch_id", "reason")


def build_silver(spark: SparkSession, config: Config, batch_date: str) -> tuple[VersionedTable, DataFrame]:
    """Merge the day's latest good orders; the dead letter is returned."""
    path = config.table("silver_orders")
    table = VersionedTable(spark, path)
    if table.version < 0:
        # not partitioned: a batch may hold any number of dates; files are skipped by their least and greatest date
        table = VersionedTable.create(spark, path, SILVER)
        table.add_constraint("amount_positive", "amount > 0")
    bronze = VersionedTable.for_path(spark, config.table("bronze")).scan({"batch_date": (batch_date, batch_date)})
    good, bad = parse(bronze)
    one = latest(good, ["order_id"], F.desc("order_time"), F.desc("amount"), "sku", "customer_id", "region")
    merge = table.merge(one, "t.order_id = s.order_id")
    merge.when_matched_update(condition="s.order_time > t.order_time").when_not_matched_insert().execute()
    return table, materialise(bad, "dead-letter")


def revenue(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Gold: revenue, orders and customers by day, region and tier. orders: order_date, customer_id, amount; customers: customer_id, region, tier."""
    joined = orders.join(customers, "customer_id", "left")
    return joined.groupBy("order_date", "region", "tier").agg(F.round(F.sum("amount"), 2).alias("revenue"), F.count("*").alias("order_count"), F.count_distinct("customer_id").alias("unique_customers"))


def top_skus(lines: DataFrame, as_of, days: int = 30, n: int = 20) -> DataFrame:
    """The n SKUs with the most revenue in the days up to ``as_of`` (a column or literal date); ties by SKU."""
    recent = lines.where((F.col("order_date") > F.date_sub(as_of, days)) & (F.col("order_date") <= as_of))
    return recent.groupBy("sku").agg(F.round(F.sum("amount"), 2).alias("revenue_30d"), F.count("*").alias("orders_30d")).orderBy(F.desc("revenue_30d"), "sku").limit(n)


def gold_checks(daily: DataFrame) -> DataFrame:
    """Per day: total revenue, whether it is within 20 % of the mean of the seven days before, and whether no region is empty or above 30 %."""
    from pyspark.sql import Window

    by_region = daily.groupBy("order_date", "region").agg(F.sum("revenue").alias("r"))
    total = by_region.groupBy("order_date").agg(F.sum("r").alias("total"), F.min("r").alias("least"), F.max("r").alias("most"))
    week = Window.orderBy(F.datediff("order_date", F.lit("1970-01-01").cast("date"))).rangeBetween(-7, -1)
    mean = F.avg("total").over(week)
    return total.select("order_date", F.round("total", 2).alias("total"), F.coalesce(F.abs(F.col("total") - mean) <= 0.2 * mean, F.lit(True)).alias("steady"), (F.col("least") > 0).alias("all_regions"), (F.col("most") < 0.3 * F.col("total")).alias("balanced"))


if __name__ == "__main__":
    main()
