"""Data quality, dimensions, the orders pipeline, and SQL forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklake.dimensions import scd
from sparklake.operators import dedup, temporal
from sparklake.pipelines import orders as pipeline
from sparklake.plans._registry import Registry, listed, table
from sparklake.quality import rules as dq
from sparklake.session import scratch_path
from sparklake.table import VersionedTable

QUERIES = Registry()
add = QUERIES.add

#: Customers with every eighth segment missing.
_DQ = "(SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer)"
RULES = [
    dq.Rule("positive", "c_acctbal > 0"),
    dq.Rule("known_segment", "seg IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')", threshold=0.9),
    dq.Rule("has_segment", "seg IS NOT NULL", severity="warn"),
]


def _checked(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 8 != 0, F.col("c_mktsegment")).alias("seg"))


_BAD_SEG = "coalesce(seg NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE'), FALSE)"


@add(
    f"""SELECT 'positive' AS name, count_if(c_acctbal <= 0)::BIGINT AS violations, count_if(c_acctbal <= 0) = 0 AS passed FROM {_DQ} UNION ALL
    SELECT 'known_segment', count_if({_BAD_SEG})::BIGINT, count_if({_BAD_SEG}) <= 0.9 * count(*) FROM {_DQ} UNION ALL SELECT 'has_segment', count_if(seg IS NULL)::BIGINT, count_if(seg IS NULL) = 0 FROM {_DQ}"""
)
def dq_report(spark, sf):
    report = dq.run(_checked(spark, sf), RULES)
    return spark.createDataFrame([(r.name, r.violations, r.passed) for r in report.results], "name string, violations long, passed boolean")


@add(f"SELECT * FROM {_DQ} WHERE c_acctbal > 0 AND NOT {_BAD_SEG}")
def dq_good(spark, sf):
    return dq.split(_checked(spark, sf), RULES)[0]


@add(f"SELECT *, array_to_string(list_filter([CASE WHEN c_acctbal <= 0 THEN 'positive' END, CASE WHEN {_BAD_SEG} THEN 'known_segment' END], lambda x: x IS NOT NULL), ',') AS _dq_reasons FROM {_DQ} WHERE c_acctbal <= 0 OR {_BAD_SEG}")
def dq_bad(spark, sf):
    return dq.split(_checked(spark, sf), RULES)[1].withColumn("_dq_reasons", listed(F.col("_dq_reasons")))


@add(f"SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal <= 0 THEN 'positive' END, CASE WHEN {_BAD_SEG} THEN 'known_segment' END, CASE WHEN seg IS NULL THEN 'has_segment' END], lambda x: x IS NOT NULL), ',') AS flags, NOT (c_acctbal <= 0 OR {_BAD_SEG}) AS ok FROM {_DQ}")
def dq_flags(spark, sf):
    return dq.with_flags(_checked(spark, sf), RULES).select("c_custkey", listed(F.col("_dq_flags")).alias("flags"), F.col("_dq_pass").alias("ok"))


@add("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def dq_unique(spark, sf):
    return dq.duplicates(table(spark, sf, "orders"), "o_custkey")


@add("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def dq_fk(spark, sf):
    return dq.orphans(table(spark, sf, "orders"), table(spark, sf, "customer").where("c_custkey % 10 <> 0"), "o_custkey", "c_custkey").select("o_orderkey")


#: Two later states of customers: day 2 changes the segment of every third, day 3 of every ninth and adds nobody.
_STATES = """SELECT c_custkey AS k, c_mktsegment AS seg, 1 AS day FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE c_mktsegment END, 2 FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, 'Y', 3 FROM customer WHERE c_custkey % 9 = 0"""
_HISTORY = f"""WITH s AS ({_STATES}), c AS (SELECT *, lag(seg) OVER w AS before FROM s WINDOW w AS (PARTITION BY k ORDER BY day)),
    h AS (SELECT k, seg, day AS valid_from, lead(day) OVER (PARTITION BY k ORDER BY day) AS valid_to FROM c WHERE before IS DISTINCT FROM seg) """


def _states(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    second = c.where("k % 2 = 0").withColumn("seg", F.when(F.col("k") % 3 == 0, "X").otherwise(F.col("seg")))
    return [c.withColumn("day", F.lit(1)), second.withColumn("day", F.lit(2)), c.where("k % 9 = 0").withColumn("seg", F.lit("Y")).withColumn("day", F.lit(3))]


def _all_states(spark, sf):
    a, b, c = _states(spark, sf)
    return c.union(a).union(b)  # late arrivals first


@add(_HISTORY + "SELECT k, seg, valid_from, valid_to, valid_to IS NULL AS is_current FROM h")
def scd2_history(spark, sf):
    return scd.type2(_all_states(spark, sf), "k", "day", ["seg"])


def _merged(spark, sf):
    batches = _states(spark, sf)
    t = scd.history_table(spark, scratch_path(spark, "scd2"), "k", batches[0], ["seg"], "day")
    for batch in batches:
        scd.apply_type2(t, batch, "k", "day", ["seg"])
    scd.apply_type2(t, batches[-1], "k", "day", ["seg"])  # a replay changes nothing
    return t.to_df()


@add(_HISTORY + "SELECT k, seg, valid_from, valid_to, valid_to IS NULL AS is_current FROM h")
def scd2_apply(spark, sf):
    return _merged(spark, sf).drop("attr_hash")


@add(_HISTORY + "SELECT k, seg, valid_from, valid_to, valid_to IS NULL AS is_current FROM h")
def scd2_apply_late(spark, sf):
    """The same states, of which the second day's come last and the third's before the first's."""
    first, second, third = _states(spark, sf)
    t = scd.history_table(spark, scratch_path(spark, "scd2"), "k", first, ["seg"], "day")
    for batch in (third, first, second, first):
        scd.apply_type2(t, batch, "k", "day", ["seg"])
    return t.to_df().drop("attr_hash")


@add(_HISTORY + "SELECT k, seg FROM h WHERE valid_to IS NULL")
def scd2_current(spark, sf):
    return scd.type4(_all_states(spark, sf), "k", "day", ["seg"])[0]


@add(_HISTORY + "SELECT o_orderkey, seg FROM orders JOIN h ON k = o_custkey AND valid_from <= 1 + o_orderkey % 4 AND (valid_to IS NULL OR valid_to > 1 + o_orderkey % 4)")
def scd2_point_in_time(spark, sf):
    facts = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), (1 + F.col("o_orderkey") % 4).cast("int").alias("at"))
    return temporal.point_in_time_join(facts, scd.type2(_all_states(spark, sf), "k", "day", ["seg"]), "k", "at").select("o_orderkey", "seg")


@add("SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN 'Y' ELSE c_mktsegment END AS seg FROM customer")
def scd1(spark, sf):
    first, _, third = _states(spark, sf)
    return scd.type1(first, third, "k").select("k", "seg")


@add("SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN 'Y' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 9 = 0 THEN c_mktsegment END AS previous_seg FROM customer")
def scd3(spark, sf):
    first, _, third = _states(spark, sf)
    return scd.type3(first, third, "k", "seg").select("k", "seg", "previous_seg")


@add(_HISTORY + "SELECT h.k, h.seg, h.valid_from, n.seg AS current_seg FROM h JOIN (SELECT k, seg FROM h WHERE valid_to IS NULL) n USING (k)")
def scd6(spark, sf):
    return scd.type6(_all_states(spark, sf), "k", "day", ["seg"]).select("k", "seg", "valid_from", "current_seg")


@add("SELECT * FROM (SELECT c_custkey AS id, c_name AS name FROM customer)")
def insert_ignore(spark, sf):
    """Insert only unseen keys: a second load of everything adds the missing half once."""
    everything = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    t = VersionedTable.from_df(everything.where("id % 2 = 0"), scratch_path(spark, "ignore"))
    for _ in range(2):
        t.append(dedup.unseen(everything, t.to_df(), "id"))
    return t.to_df()


@add("SELECT 'load' AS job, 'b1' AS batch, count(*) AS rows, TRUE AS completed FROM orders")
def process_log(spark, sf):
    """Start and completion marks of a job's batch, one row however often it is retried."""
    t = VersionedTable.create(spark, scratch_path(spark, "log"), "job string, batch string, rows long, completed boolean")
    n = table(spark, sf, "orders").count()
    for rows, completed in ((None, False), (n, True), (n, True)):
        mark = spark.createDataFrame([("load", "b1", rows, completed)], "job string, batch string, rows long, completed boolean")
        t.merge(mark, "t.job = s.job AND t.batch = s.batch").when_matched_update(condition="NOT t.completed").when_not_matched_insert().execute()
    return t.to_df()


#: Orders as JSON: every tenth amount is negative, every fifteenth line is cut.
def _raw_orders(spark, sf):
    o = table(spark, sf, "orders")
    fields = F.struct(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderpriority").alias("sku"),
        F.when(F.col("o_orderkey") % 10 == 0, -1.0).otherwise(F.round("o_totalprice", 2)).cast("decimal(18,2)").alias("amount"),
        F.col("o_orderstatus").alias("region"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_time"),
    )
    line = F.to_json(fields)
    return o.select(F.when(F.col("o_orderkey") % 15 == 1, F.substring(line, 1, 20)).otherwise(line).alias("value"))


def _loaded(spark, sf):
    config, source = pipeline.Config(scratch_path(spark, "orders")), scratch_path(spark, "landing")
    _raw_orders(spark, sf).write.text(source)
    for batch in ("b1", "b2"):  # a rerun of the day
        pipeline.ingest_bronze(spark, config, source, "2024-01-01", batch)
    return config


@add("SELECT DATE '2024-01-01' AS batch_date, 'b2' AS batch_id, count(*) AS n FROM orders")
def etl_bronze(spark, sf):
    config = _loaded(spark, sf)
    return VersionedTable.for_path(spark, config.table("bronze")).to_df().groupBy("batch_date", "batch_id").agg(F.count("*").alias("n"))


@add("SELECT o_orderkey::VARCHAR AS order_id, o_totalprice::DECIMAL(18,2)::DOUBLE AS amount, o_orderdate::DATE AS order_date FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 15 <> 1")
def etl_silver(spark, sf):
    config = _loaded(spark, sf)
    for _ in range(2):  # a replay merges nothing new
        silver, _ = pipeline.build_silver(spark, config, "2024-01-01")
    return silver.to_df().select("order_id", F.col("amount").cast("double").alias("amount"), "order_date")


@add("SELECT CASE WHEN o_orderkey % 15 = 1 THEN 'no order_id,no customer_id,no sku,no amount,no order_time' ELSE 'amount not positive' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 15 = 1 GROUP BY 1")
def etl_dead_letter(spark, sf):
    _, bad = pipeline.build_silver(spark, _loaded(spark, sf), "2024-01-01")
    cut = F.col("reason").contains("no customer_id")
    return bad.select(F.when(cut, "no order_id,no customer_id,no sku,no amount,no order_time").otherwise(F.col("reason")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_REVENUE = """SELECT o_orderdate::DATE AS order_date, r_name AS region, c_mktsegment AS tier, round(sum(o_totalprice), 2) AS revenue, count(*) AS order_count, count(DISTINCT o_custkey) AS unique_customers
    FROM orders LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON o_custkey = c_custkey GROUP BY ALL"""


def _revenue(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")  # fixed tables of a few rows
    who = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = who.select(F.col("c_custkey").alias("customer_id"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("tier"))
    orders = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("order_date"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("amount"))
    return pipeline.revenue(orders, customers)


@add(_REVENUE)
def gold_revenue(spark, sf):
    return _revenue(spark, sf)


@add(
    """WITH l AS (SELECT l_partkey AS sku, l_extendedprice AS amount, l_shipdate::DATE AS d FROM lineitem), m AS (SELECT max(d) AS as_of FROM l)
    SELECT sku, round(sum(amount), 2) AS revenue_30d, count(*) AS orders_30d FROM l, m WHERE d > as_of - 30 AND d <= as_of GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
)
def gold_top_skus(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("sku"), F.col("l_extendedprice").alias("amount"), F.to_date("l_shipdate").alias("order_date"))
    as_of = lines.agg(F.max("order_date")).first()[0]
    return pipeline.top_skus(lines, F.lit(as_of))


@add(
    f"""WITH g AS ({_REVENUE}), r AS (SELECT order_date, region, sum(revenue) AS r FROM g GROUP BY ALL), t AS (SELECT order_date, sum(r) AS total, min(r) AS least, max(r) AS most FROM r GROUP BY 1),
    w AS (SELECT *, avg(total) OVER (ORDER BY order_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS mean FROM t)
    SELECT order_date, round(total, 2) AS total, coalesce(abs(total - mean) <= 0.2 * mean, TRUE) AS steady, least > 0 AS all_regions, most < 0.3 * total AS balanced FROM w"""
)
def gold_checks(spark, sf):
    return pipeline.gold_checks(_revenue(spark, sf))


@add(
    """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1500000)
    SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, round(sum(t), 2) AS total FROM big JOIN customer ON o_custkey = c_custkey GROUP BY 1"""
)
def sql_cte(spark, sf):
    return spark.sql(
        """WITH big AS (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS t FROM {o} GROUP BY 1 HAVING sum(o_totalprice) > 1500000)
        SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, round(sum(t), 2) AS total FROM big JOIN {c} USING (c_custkey) GROUP BY 1""",
        o=table(spark, sf, "orders"),
        c=table(spark, sf, "customer"),
    )


@add("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def sql_vs_df(spark, sf):
    """Both forms in one plan: rows where they differ would be lost."""
    o = table(spark, sf, "orders")
    a = spark.sql("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM {o} WHERE o_orderstatus = 'F' GROUP BY 1", o=o)
    b = o.where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return a.intersect(b)


@add("SELECT 'temp' AS kind, 25::BIGINT AS n UNION ALL SELECT 'global', 5 UNION ALL SELECT 'catalog', 1")
def catalog_views(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("sparklake_nation")
    table(spark, sf, "region").createOrReplaceGlobalTempView("sparklake_region")
    listed = sum(t.name == "sparklake_nation" for t in spark.catalog.listTables(pattern="sparklake_*"))
    a = spark.table("sparklake_nation").agg(F.lit("temp").alias("kind"), F.count("*").alias("n"))
    b = spark.table("global_temp.sparklake_region").agg(F.lit("global"), F.count("*"))
    return a.union(b).union(spark.createDataFrame([("catalog", listed)], "kind string, n long"))


@add("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def ddl_table(spark, sf):
    path = scratch_path(spark, "ddl")
    name = "sparklake_" + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE TABLE {name} (n_nationkey INT, n_name STRING, n_regionkey INT) USING parquet PARTITIONED BY (n_regionkey) LOCATION '{path}'")
    table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").write.insertInto(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS n_name")
    return spark.table(name).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@add("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def checkpointed(spark, sf):
    """Lineage cut by a checkpoint in the shared folder, then used twice."""
    scratch_path(spark, "x")  # sets the folder
    held = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice").checkpoint()
    a = held.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return a.join(held.groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total")), "o_orderstatus")
