"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklake.operators import skew
from sparklake.plans._registry import Registry, listed, table

QUERIES = Registry()
add = QUERIES.add


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


@add("SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem")
def agg_global(spark, sf):
    return _lines(spark, sf).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


@add(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(avg(l_quantity), 4) AS avg_qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def agg_group(spark, sf):
    kept = _lines(spark, sf).where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return kept.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
    )


@add("SELECT count(*) AS all_rows, count(nullif(event_type, 'view')) AS with_kind, count_if(value > 50)::BIGINT AS large FROM events")
def agg_counts(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("all_rows"), F.count(F.nullif("event_type", F.lit("view"))).alias("with_kind"), F.count_if(F.col("value") > 50).alias("large"))


@add("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1")
def agg_distinct(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("statuses"))


@add("SELECT TRUE AS close")
def agg_approx_distinct(spark, sf):
    found = table(spark, sf, "orders").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.count_distinct("o_custkey").alias("e"))
    return found.select((F.abs(F.col("a") - F.col("e")) <= 0.08 * F.col("e")).alias("close"))


@add("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1")
def agg_percentile(spark, sf):
    found = _lines(spark, sf).groupBy("l_returnflag").agg(F.percentile_approx("l_quantity", [0.5, 0.9], 100000).alias("p"))
    return found.select("l_returnflag", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"))


@add("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(median(l_extendedprice), 4) AS mid FROM lineitem GROUP BY 1")
def agg_percentile_exact(spark, sf):
    return _lines(spark, sf).groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", 0.25), 4).alias("p25"), F.round(F.median("l_extendedprice"), 4).alias("mid"))


@add("SELECT TRUE AS close")
def agg_approx_quantile(spark, sf):
    """approxQuantile as an aggregate: within the error of the exact rank."""
    found = table(spark, sf, "orders").agg(F.percentile_approx("o_totalprice", 0.5, 1000).alias("a"), F.percentile("o_totalprice", F.array(F.lit(0.49), F.lit(0.51))).alias("e"))
    return found.select(F.col("a").between(F.col("e")[0], F.col("e")[1]).alias("close"))


@add(
    """SELECT round(stddev(l_quantity), 4) AS sd, round(variance(l_quantity), 4) AS var, round(var_pop(l_quantity), 4) AS varp, round(kurtosis_pop(l_quantity), 4) AS kurt,
    round(corr(l_quantity, l_extendedprice), 4) AS corr, round(covar_samp(l_quantity, l_discount), 4) AS cov FROM lineitem"""
)
def agg_moments(spark, sf):
    return _lines(spark, sf).agg(
        F.round(F.stddev("l_quantity"), 4).alias("sd"),
        F.round(F.variance("l_quantity"), 4).alias("var"),
        F.round(F.var_pop("l_quantity"), 4).alias("varp"),
        F.round(F.kurtosis("l_quantity"), 4).alias("kurt"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 4).alias("corr"),
        F.round(F.covar_samp("l_quantity", "l_discount"), 4).alias("cov"),
    )


@add("SELECT round(sum((v - m) ** 3) / count(*) / power(sum((v - m) ** 2) / count(*), 1.5), 4) AS skew FROM (SELECT o_totalprice AS v, avg(o_totalprice) OVER () AS m FROM orders)")
def agg_skewness(spark, sf):
    return table(spark, sf, "orders").agg(F.round(F.skewness("o_totalprice"), 4).alias("skew"))


@add("SELECT user_id, min_by(event_type, event_id) AS first_kind, max_by(event_type, event_id) AS last_kind FROM events GROUP BY 1")
def agg_first_last(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_kind"), F.max_by("event_type", "event_id").alias("last_kind"))


@add("SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names, array_to_string(list_sort(list(DISTINCT substr(n_name, 1, 1))), ',') AS letters FROM nation GROUP BY 1")
def agg_collect(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(listed(F.sort_array(F.collect_list("n_name"))).alias("names"), listed(F.sort_array(F.collect_set(F.substring("n_name", 1, 1)))).alias("letters"))


def _shaped(shape):
    def run(spark, sf):
        orders = table(spark, sf, "orders")
        grouped = getattr(orders, shape)("o_orderstatus", "o_orderpriority")
        return grouped.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    return run


for _shape in ("rollup", "cube"):
    QUERIES.add(f"SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::INTEGER AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY {_shape.upper()} (o_orderstatus, o_orderpriority)", f"agg_{_shape}")(_shaped(_shape))


@add("SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::INTEGER AS level, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def agg_grouping_sets(spark, sf):
    return spark.sql(
        "SELECT o_orderstatus, o_orderpriority, CAST(grouping_id() AS INT) AS level, count(*) AS n FROM {o} GROUP BY o_orderstatus, o_orderpriority GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
        o=table(spark, sf, "orders"),
    )


@add("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1")
def agg_pivot(spark, sf):
    found = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).count()
    return found.na.fill(0)


@add("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def agg_having(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@add("SELECT user_id, round(max(value) - min(value), 4) AS spread FROM events GROUP BY 1")
def agg_expr(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.max("value") - F.min("value"), 4).alias("spread"))


@add("SELECT o_orderkey % 3 AS r, count(*) AS n FROM orders GROUP BY 1")
def agg_group_expr(spark, sf):
    return table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 3).alias("r")).agg(F.count("*").alias("n"))


@add("SELECT CASE WHEN event_id % 5 < 4 THEN 999 ELSE user_id END AS u, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def agg_two_pass(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value", F.when(F.col("event_id") % 5 < 4, F.lit(999).cast("long")).otherwise(F.col("user_id")).alias("u"))
    found = skew.two_pass_aggregate(events, ["u"], ("event_id",), {"total": "value"})
    return found.select("u", "n", F.round("total", 2).alias("total"))


@add("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@add("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 0.008 * (SELECT count(*) FROM events)")
def key_skew(spark, sf):
    events = table(spark, sf, "events")
    return skew.key_counts(events, "user_id").join(skew.hot_keys(events, "user_id", 0.008), "user_id")


@add("SELECT count(DISTINCT user_id) FILTER (event_type = 'view') AS viewed, count(DISTINCT user_id) FILTER (event_type = 'click') AS clicked, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS bought FROM events")
def funnel(spark, sf):
    each = table(spark, sf, "events").groupBy("user_id").agg(*[F.max((F.col("event_type") == k).cast("int")).alias(n) for n, k in (("viewed", "view"), ("clicked", "click"), ("bought", "purchase"))])
    return each.agg(*[F.sum(c).alias(c) for c in ("viewed", "clicked", "bought")])


@add("SELECT TRUE AS hll_close, TRUE AS merged_close, TRUE AS sketched")
def agg_sketches(spark, sf):
    """HyperLogLog sketches merge over groups; a Count-Min sketch is built in one pass."""
    orders = table(spark, sf, "orders")
    whole = orders.agg(F.hll_sketch_estimate(F.hll_sketch_agg("o_custkey")).alias("a"), F.count_distinct("o_custkey").alias("e"), F.count_min_sketch("o_custkey", F.lit(0.01), F.lit(0.9), F.lit(7)).alias("s"))
    parts = orders.groupBy("o_orderpriority").agg(F.hll_sketch_agg("o_custkey").alias("k")).agg(F.hll_sketch_estimate(F.hll_union_agg("k")).alias("m"))
    close = lambda c: F.abs(F.col(c) - F.col("e")) <= 0.08 * F.col("e")
    return whole.crossJoin(parts).select(close("a").alias("hll_close"), close("m").alias("merged_close"), (F.octet_length("s") > 0).alias("sketched"))


@add("SELECT TRUE AS only_f, TRUE AS all_f")
def sample_stratified(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    got = orders.sampleBy("o_orderstatus", {"F": 1.0, "O": 0.0}, seed=3)
    n = orders.where("o_orderstatus = 'F'").agg(F.count("*").alias("n"))
    return got.agg((F.count_if(F.col("o_orderstatus") != "F") == 0).alias("only_f"), F.count("*").alias("c")).crossJoin(n).select("only_f", (F.col("c") == F.col("n")).alias("all_f"))


@add("SELECT o_orderstatus, count(*) AS n, 2::BIGINT AS uses FROM orders GROUP BY 1")
def cached(spark, sf):
    """A result used twice is kept once, and let go after."""
    held = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).persist()
    try:
        uses = sum(held.count() > 0 for _ in range(2))
        return spark.createDataFrame([(r.o_orderstatus, r.n, uses) for r in held.collect()], "o_orderstatus string, n long, uses long")  # a few statuses
    finally:
        held.unpersist()


@add("SELECT TRUE AS pushed, TRUE AS pruned, TRUE AS generated")
def plan_checks(spark, sf):
    """What the physical plan of a filter and an aggregation shows."""
    df = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    df.collect()
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return spark.createDataFrame([("GreaterThan(l_quantity" in plan, "l_comment" not in plan, "WholeStageCodegen" in plan or "codegen id" in plan)], "pushed boolean, pruned boolean, generated boolean")
