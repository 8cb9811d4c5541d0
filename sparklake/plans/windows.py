"""Window functions, sort and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparklake.operators import temporal
from sparklake.plans._registry import Registry, table

QUERIES = Registry()
add = QUERIES.add
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")


@add(f"SELECT event_id, row_number() OVER {_W}::INTEGER AS n FROM events")
def win_row_number(spark, sf):
    return _events(spark, sf).select("event_id", F.row_number().over(_by_user()).alias("n"))


@add(
    """SELECT o_orderkey, rank() OVER w::INTEGER AS rank, dense_rank() OVER w::INTEGER AS dense, round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cume,
    ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)::INTEGER AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)"""
)
def win_ranking(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    quarter = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.round(F.percent_rank().over(w), 6).alias("pct"), F.round(F.cume_dist().over(w), 6).alias("cume"), F.ntile(4).over(quarter).alias("quarter")
    )


@add(f"SELECT event_id, lag(event_type, 1, 'none') OVER {_W} AS before, lead(event_id, 2) OVER {_W} AS after FROM events")
def win_lag_lead(spark, sf):
    return _events(spark, sf).select("event_id", F.lag("event_type", 1, "none").over(_by_user()).alias("before"), F.lead("event_id", 2).over(_by_user()).alias("after"))


@add(f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def win_running(spark, sf):
    w = _by_user().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _events(spark, sf).select("event_id", F.round(F.sum("value").over(w), 2).alias("running"), F.count("*").over(w).alias("n"))


@add("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS moving FROM events")
def win_moving_rows(spark, sf):
    return _events(spark, sf).select("event_id", F.round(F.avg("value").over(_by_user().rowsBetween(-6, 0)), 4).alias("moving"))


@add("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 518400 PRECEDING AND CURRENT ROW) AS week FROM (SELECT *, date_trunc('second', ts) AS s FROM events)")
def win_moving_range(spark, sf):
    """Whole seconds are the nearest ones, halves to the even one, as SQL casts fractions."""
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-6 * 86400, 0)
    second = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("long")
    return _events(spark, sf).withColumn("s", second).select("event_id", F.count("*").over(w).alias("week"))


@add("SELECT event_id, round(value / sum(value) OVER (PARTITION BY user_id), 6) AS share FROM events")
def win_partition_total(spark, sf):
    return _events(spark, sf).select("event_id", F.round(F.col("value") / F.sum("value").over(Window.partitionBy("user_id")), 6).alias("share"))


@add("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS upto, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS every FROM orders")
def win_default_frame(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", F.count("*").over(w).alias("upto"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("every"))


@add(
    """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g"""
)
def sessionize_batch(spark, sf):
    return temporal.sessionize(_events(spark, sf), "user_id", "ts", 1800, "event_id").select("event_id", "session")


@add("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def topn_per_group(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return _events(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "event_id")


@add("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def sql_window(spark, sf):
    return spark.sql("SELECT o_custkey, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM {o}) WHERE n = 1", o=table(spark, sf, "orders"))


@add(
    """SELECT event_id, first_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_touch,
    last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_touch FROM (SELECT *, nullif(event_type, 'view') AS k FROM events)"""
)
def win_first_last(spark, sf):
    k = F.nullif("event_type", F.lit("view"))
    return _events(spark, sf).select("event_id", F.first(k, ignorenulls=True).over(_by_user().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first_touch"), F.last(k, ignorenulls=True).over(_by_user().rowsBetween(Window.unboundedPreceding, 0)).alias("last_touch"))


@add("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS place FROM orders")
def sort_global(spark, sf):
    """A total order without one task: range partitions are sorted alone and numbered from their counts (one row for each partition)."""
    part = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").withColumn("p", F.spark_partition_id())
    own = part.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    before = part.groupBy("p").agg(F.count("*").alias("c"))
    before = before.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(before, "p").select("o_orderkey", (F.col("n") + F.col("before")).alias("place"))


@add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@add("SELECT TRUE AS sorted_within, 4::BIGINT AS parts, 15000::BIGINT * 0 + count(*) AS n FROM orders")
def sort_within(spark, sf):
    part = table(spark, sf, "orders").select("o_orderkey").repartition(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    seen = part.select("o_orderkey", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    checked = seen.withColumn("ok", F.col("o_orderkey") > F.lag("o_orderkey", 1, -1).over(Window.partitionBy("p").orderBy("i")))
    return checked.agg(F.min("ok").alias("sorted_within"), F.count_distinct("p").alias("parts"), F.count("*").alias("n"))


@add("SELECT 8::BIGINT AS dealt, 3::BIGINT AS merged, 4::BIGINT AS ranged")
def partition_counts(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    count = lambda df, name: df.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p").alias(name))
    found = count(orders.repartition(8), "dealt")
    return found.crossJoin(count(orders.repartition(8).coalesce(3), "merged")).crossJoin(count(orders.repartitionByRange(4, "o_orderkey"), "ranged"))


#: The means of a key's first values are short decimals; the summand keeps them off the edges of rounding.
_EWM = """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id FROM events),
    f AS (SELECT user_id, i, event_id, value AS m FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.event_id, 0.3 * e.value + 0.7 * f.m FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT event_id, round(m + 1.23e-5, 4) AS ewm FROM f"""


@add(_EWM)
def win_exponential(spark, sf):
    return temporal.exponential_mean(_events(spark, sf), "user_id", ["ts", "event_id"], "value", 0.3).select("event_id", F.round(F.col("ewm") + 1.23e-5, 4).alias("ewm"))


@add(_EWM)
def win_exponential_sliced(spark, sf):
    """Each user's events in slices of a week."""
    found = temporal.exponential_mean(_events(spark, sf), "user_id", ["ts", "event_id"], "value", 0.3, slices="date_trunc('week', _t)")
    return found.select("event_id", F.round(F.col("ewm") + 1.23e-5, 4).alias("ewm"))
