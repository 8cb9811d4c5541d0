"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklake.operators import dedup, skew, temporal
from sparklake.plans._registry import Registry, table

QUERIES = Registry()
add = QUERIES.add


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def _sides(spark, sf):
    """Keys that only one side has: those of the building segment's customers are negated."""
    key = F.when(F.col("c_mktsegment") == "BUILDING", -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    return _customers(spark, sf).select(key.alias("k"), "c_name"), _orders(spark, sf).select(F.col("o_custkey").alias("k"), "o_orderkey")


_SIDES = "WITH c AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN -c_custkey ELSE c_custkey END AS k, c_name FROM customer), o AS (SELECT o_custkey AS k, o_orderkey FROM orders) "


@add("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    return _orders(spark, sf).join(_customers(spark, sf), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


def _outer(how):
    def run(spark, sf):
        a, b = _sides(spark, sf)
        return a.join(b, "k", how)

    return run


for _name, _how in (("join_left", "left"), ("join_right", "right"), ("join_full", "full")):
    QUERIES.add(_SIDES + f"SELECT k, c_name, o_orderkey FROM c {_how.upper()} JOIN o USING (k)", _name)(_outer(_how))


@add(_SIDES + "SELECT k, c_name FROM c WHERE k IN (SELECT k FROM o)")
def join_semi(spark, sf):
    a, b = _sides(spark, sf)
    return a.join(b, "k", "left_semi")


@add(_SIDES + "SELECT k, c_name FROM c WHERE k NOT IN (SELECT k FROM o)")
def join_anti(spark, sf):
    a, b = _sides(spark, sf)
    return a.join(b, "k", "left_anti")


@add("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf):
    return table(spark, sf, "region").select("r_name").crossJoin(table(spark, sf, "nation").select("n_name"))


@add("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def join_theta(spark, sf):
    n = table(spark, sf, "nation")
    on = (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_regionkey") == F.col("b.n_regionkey"))
    return n.alias("a").join(n.alias("b"), on).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


def _hinted(hint):
    def run(spark, sf):
        nation = table(spark, sf, "nation").hint(hint)
        joined = _customers(spark, sf).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.groupBy("n_name").agg(F.count("*").alias("n"))

    return run


for _name, _hint in (("join_broadcast", "broadcast"), ("join_sortmerge", "merge"), ("join_shuffle_hash", "shuffle_hash")):
    QUERIES.add("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", _name)(_hinted(_hint))

#: Price bands.
_BANDS = ((1, 0.0, 999.99), (2, 1000.0, 49999.99), (3, 50000.0, 149999.99), (4, 100000.0, 249999.99), (5, 250000.0, 1e12))
_BAND_SQL = f"(VALUES {', '.join(f'({n}, {lo}::DOUBLE, {hi}::DOUBLE)' for n, lo, hi in _BANDS)}) b(band, lo, hi)"


@add(f"SELECT o_orderkey, band FROM orders JOIN {_BAND_SQL} ON o_totalprice BETWEEN lo AND hi")
def join_range(spark, sf):
    """Ranges that overlap, a few whatever the input."""
    bands = spark.createDataFrame(_BANDS, "band int, lo double, hi double")
    return _orders(spark, sf).join(F.broadcast(bands), F.col("o_totalprice").between(F.col("lo"), F.col("hi"))).select("o_orderkey", "band")


@add("SELECT p.event_id, r.event_id AS range_id FROM events p JOIN events r ON p.event_id BETWEEN r.event_id AND r.event_id + 3 + r.user_id % 5")
def join_range_bucketed(spark, sf):
    """A range from every event."""
    events = table(spark, sf, "events")
    ranges = events.selectExpr("event_id AS range_id", "event_id AS lo", "event_id + 3 + user_id % 5 AS hi")
    return temporal.range_join(events.select("event_id"), ranges, "event_id", "lo", "hi", 8).select("event_id", "range_id")


_ASOF = """SELECT c.event_id, p.ts AS bought_at, p.value AS bought FROM (SELECT * FROM events WHERE event_type = 'click') c
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p
    ON c.user_id = p.user_id AND c.ts >= p.ts"""


def _asof(slices):
    def run(spark, sf):
        events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
        bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("value").alias("bought"))
        clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
        return temporal.asof_join(clicks, bought, "user_id", "ts", "bought_at", ("bought",), slices).select("event_id", "bought_at", "bought")

    return run


QUERIES.add(_ASOF, "join_asof")(_asof(None))
QUERIES.add(_ASOF, "join_asof_sliced")(_asof("date_trunc('day', _t)"))


@add("SELECT r_name, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_join(spark, sf):
    nation, region = (table(spark, sf, t) for t in ("nation", "region"))  # a few rows at any scale factor
    joined = _orders(spark, sf).join(_customers(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"))


#: Four of five events belong to user 999, who is known only to the skewed side and the small table's last row.
_SKEWED = "(SELECT event_id, CASE WHEN event_id % 5 < 4 THEN 999 ELSE user_id END AS u, value FROM events)"
_USERS = "(SELECT DISTINCT user_id AS u, 'user' || user_id AS name FROM events UNION SELECT 999, 'hot')"
_SKEW_SQL = f"SELECT name, count(*) AS n, round(sum(value), 2) AS total FROM {_SKEWED} JOIN {_USERS} USING (u) GROUP BY 1"


def _skewed(spark, sf):
    events = table(spark, sf, "events")
    big = events.select("event_id", F.when(F.col("event_id") % 5 < 4, F.lit(999).cast("long")).otherwise(F.col("user_id")).alias("u"), "value")
    small = events.select("user_id").distinct().select(F.col("user_id").alias("u"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"))
    return big, small.union(spark.range(1).select(F.lit(999).cast("long"), F.lit("hot"))).distinct()


def _totals(joined):
    return joined.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@add(_SKEW_SQL)
def join_salted(spark, sf):
    return _totals(skew.salted_join(*_skewed(spark, sf), "u", ("event_id",)))


@add(_SKEW_SQL)
def join_salted_selective(spark, sf):
    return _totals(skew.selective_salted_join(*_skewed(spark, sf), "u", ("event_id",)))


@add(_SKEW_SQL)
def join_hot_split(spark, sf):
    return _totals(skew.hot_split_join(*_skewed(spark, sf), "u", ("event_id",)))


@add(_SKEW_SQL)
def join_aqe_skew(spark, sf):
    big, small = _skewed(spark, sf)
    return _totals(big.join(small.hint("merge"), "u"))


@add("SELECT c_mktsegment, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def preagg_join(spark, sf):
    each = _orders(spark, sf).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    return each.join(_customers(spark, sf), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.round(F.sum("t"), 2).alias("total"))


@add(
    """WITH a AS (SELECT event_id, nullif(event_type, 'view') AS k FROM events), b AS (SELECT DISTINCT nullif(event_type, 'view') AS k FROM events)
    SELECT 'inner' AS kind, count(*) AS n FROM a JOIN b USING (k) UNION ALL SELECT 'anti', count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k)"""
)
def join_null_keys(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("k"))
    known = events.select("k").distinct()
    inner = events.join(known, "k").agg(F.lit("inner").alias("kind"), F.count("*").alias("n"))
    return inner.union(events.join(known, "k", "left_anti").agg(F.lit("anti"), F.count("*")))


@add("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE user_id % 3 = 0)")
def dedup_seen_filter(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    return dedup.unseen(events, events.where("user_id % 3 = 0"), "event_id").select("event_id")


@add("SELECT count(*) AS pairs FROM (SELECT n_regionkey AS k FROM nation) a JOIN (SELECT r_regionkey AS k FROM region) b USING (k)")
def join_using_sql(spark, sf):
    return spark.sql("SELECT count(*) AS pairs FROM (SELECT n_regionkey AS k FROM {n}) a JOIN (SELECT r_regionkey AS k FROM {r}) b USING (k)", n=table(spark, sf, "nation"), r=table(spark, sf, "region"))
