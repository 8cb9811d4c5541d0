"""Set operations and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklake.operators import dedup
from sparklake.plans._registry import Registry, table

QUERIES = Registry()
add = QUERIES.add


def _two(spark, sf):
    c = table(spark, sf, "customer")
    rich = F.when(F.col("c_acctbal") > 5000, "RICH").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    return c.select("c_nationkey", "c_mktsegment"), c.select(F.nullif("c_nationkey", F.lit(7)).alias("c_nationkey"), rich)


_A = "SELECT c_nationkey, c_mktsegment FROM customer"
_B = "SELECT nullif(c_nationkey, 7) AS c_nationkey, CASE WHEN c_acctbal > 5000 THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment FROM customer"


@add(f"{_A} UNION ALL {_B}")
def set_union_all(spark, sf):
    a, b = _two(spark, sf)
    return a.union(b)


@add(f"SELECT c_nationkey, c_mktsegment, NULL::INTEGER AS extra FROM ({_A}) UNION ALL SELECT c_nationkey, c_mktsegment, 1 FROM ({_B})")
def set_union_by_name(spark, sf):
    a, b = _two(spark, sf)
    return a.unionByName(b.select(F.lit(1).alias("extra"), "c_mktsegment", "c_nationkey"), allowMissingColumns=True)


@add(f"{_A} UNION {_B}")
def set_union_distinct(spark, sf):
    a, b = _two(spark, sf)
    return a.union(b).distinct()


@add(f"{_A} INTERSECT {_B}")
def set_intersect(spark, sf):
    a, b = _two(spark, sf)
    return a.intersect(b)


@add(f"{_A} EXCEPT {_B}")
def set_except(spark, sf):
    a, b = _two(spark, sf)
    return a.subtract(b)


@add(f"{_A} EXCEPT ALL {_B}")
def set_except_all(spark, sf):
    a, b = _two(spark, sf)
    return a.exceptAll(b)


@add("SELECT DISTINCT user_id, event_type FROM events")
def dedup_any(spark, sf):
    return dedup.any_row(table(spark, sf, "events"), "user_id", "event_type").select("user_id", "event_type")


_LATEST = "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1"


def _events(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", "ts", "value")


@add(_LATEST)
def dedup_latest(spark, sf):
    return dedup.latest(_events(spark, sf), ["user_id"], F.desc("ts"), "event_id").select("user_id", "event_id", "value")


@add(_LATEST)
def dedup_salted(spark, sf):
    return dedup.latest_salted(_events(spark, sf), ["user_id"], ("event_id",), F.desc("ts"), "event_id").select("user_id", "event_id", "value")


@add(_LATEST)
def dedup_aggregate(spark, sf):
    return dedup.latest_by_aggregate(_events(spark, sf), ["user_id"], F.struct("ts", -F.col("event_id"))).select("user_id", "event_id", "value")


@add("SELECT event_type, props FROM (SELECT event_type, props, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts) DESC, props DESC) AS n FROM events) WHERE n = 1")
def dedup_tiebreak(spark, sf):
    events = table(spark, sf, "events").select("event_type", "props", F.date_trunc("day", "ts").alias("day"))
    return dedup.latest(events, ["event_type"], F.desc("day"), F.desc("props")).select("event_type", "props")


@add("SELECT count(DISTINCT (c_nationkey, c_mktsegment)) AS n FROM customer")
def row_hash(spark, sf):
    return table(spark, sf, "customer").select(dedup.content_hash("c_nationkey", "c_mktsegment").alias("h")).agg(F.count_distinct("h").alias("n"))
