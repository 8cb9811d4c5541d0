"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklake.plans._registry import Registry, table

QUERIES = Registry()
add = QUERIES.add


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


@add("SELECT o_orderkey AS order_id, o_totalprice * 2 AS double_price FROM orders")
def project(spark, sf):
    return _orders(spark, sf).select(F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice") * 2).alias("double_price"))


@add("SELECT o_orderkey, upper(o_orderstatus) AS status, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size_class FROM orders")
def select_expr(spark, sf):
    return _orders(spark, sf).selectExpr("o_orderkey", "upper(o_orderstatus) AS status", "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size_class")


@add("SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, (o_totalprice + 1) * 2 AS twice FROM orders")
def with_column(spark, sf):
    return _orders(spark, sf).select("o_orderkey", "o_totalprice").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("twice", F.col("o_totalprice") * 2)


@add("SELECT r_regionkey AS id, r_name AS name FROM region")
def rename(spark, sf):
    return table(spark, sf, "region").withColumnsRenamed({"r_regionkey": "id", "r_name": "name"}).withColumnRenamed("absent", "x")


@add("SELECT o_orderkey, o_custkey FROM orders")
def drop_cols(spark, sf):
    return _orders(spark, sf).drop("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "absent")


@add("SELECT r_regionkey, 1 AS one, 'x' AS letter, NULL::DOUBLE AS nothing FROM region")
def literals(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", F.lit(1).alias("one"), F.lit("x").alias("letter"), F.lit(None).cast("double").alias("nothing"))


@add("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def struct_expand(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.*")


@add("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3 AND o_totalprice - 1000 >= 50000")
def filter_basic(spark, sf):
    return _orders(spark, sf).filter(F.col("o_orderkey") % 7 == 3).where("o_totalprice - 1000 >= 50000").select("o_orderkey")


@add("SELECT event_id FROM events WHERE NOT (nullif(event_type, 'view') = 'click' OR value > 50) AND user_id < 100")
def filter_bool(spark, sf):
    kind = F.nullif("event_type", F.lit("view"))
    return table(spark, sf, "events").where(~((kind == "click") | (F.col("value") > 50)) & (F.col("user_id") < 100)).select("event_id")


@add("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def filter_between(spark, sf):
    return table(spark, sf, "lineitem").where(F.col("l_quantity").between(10, 12)).select("l_orderkey", "l_linenumber")


@add("SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IN ('MACHINERY', 'AUTOMOBILE')")
def filter_in(spark, sf):
    return table(spark, sf, "customer").where(F.nullif("c_mktsegment", F.lit("BUILDING")).isin("MACHINERY", "AUTOMOBILE")).select("c_custkey")


@add("SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' OR p_type LIKE '%STEEL' OR contains(p_name, 'a b')")
def filter_string(spark, sf):
    return table(spark, sf, "part").where(F.col("p_brand").startswith("Brand#1") | F.col("p_type").endswith("STEEL") | F.col("p_name").contains("a b")).select("p_partkey")


@add("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[13]{2}$')")
def filter_rlike(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_name").rlike("[13]{2}$")).select("c_custkey", "c_name")


@add("SELECT event_id, nullif(event_type, 'view') IS NULL AS missing, nullif(event_type, 'view') IS NOT NULL AS present, isnan(value) AS odd FROM events")
def null_checks(spark, sf):
    kind = F.nullif("event_type", F.lit("view"))
    return table(spark, sf, "events").select("event_id", kind.isNull().alias("missing"), kind.isNotNull().alias("present"), F.isnan("value").alias("odd"))


@add("SELECT event_id, nullif(event_type, 'view') IS NOT DISTINCT FROM nullif(event_type, 'click') AS same FROM events")
def eq_null_safe(spark, sf):
    return table(spark, sf, "events").select("event_id", F.nullif("event_type", F.lit("view")).eqNullSafe(F.nullif("event_type", F.lit("click"))).alias("same"))


@add("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'gold' WHEN o_totalprice > 100000 THEN 'silver' END AS tier FROM orders")
def case_when(spark, sf):
    return _orders(spark, sf).select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "gold").when(F.col("o_totalprice") > 100000, "silver").alias("tier"))


@add("SELECT o_orderkey, o_orderkey::VARCHAR AS as_text, trunc(o_totalprice)::BIGINT AS as_long, o_totalprice::DECIMAL(18,2)::VARCHAR AS as_money, o_orderdate::DATE AS as_date, TRY_CAST(o_orderpriority AS INTEGER) AS bad FROM orders")
def cast_types(spark, sf):
    return _orders(spark, sf).select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("as_text"),
        F.col("o_totalprice").cast("long").alias("as_long"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("as_money"),
        F.col("o_orderdate").cast("date").alias("as_date"),
        F.col("o_orderpriority").try_cast("int").alias("bad"),
    )


@add("SELECT o_orderkey, (o_totalprice > 100000)::INTEGER AS is_big FROM orders")
def bool_to_int(spark, sf):
    return _orders(spark, sf).select("o_orderkey", (F.col("o_totalprice") > 100000).cast("int").alias("is_big"))


@add("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' END AS status FROM orders")
def map_lookup(spark, sf):
    names = F.create_map(F.lit("O"), F.lit("open"), F.lit("F"), F.lit("final"))
    return _orders(spark, sf).select("o_orderkey", F.try_element_at(names, "o_orderstatus").alias("status"))


@add("SELECT n_nationkey, n_name AS inner_name, n_regionkey + 1 AS inner_next FROM nation")
def struct_build(spark, sf):
    made = table(spark, sf, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).alias("next")).alias("s"))
    return made.select("n_nationkey", F.col("s.name").alias("inner_name"), F.col("s")["next"].alias("inner_next"))


@add("SELECT event_id, CASE coalesce(nullif(event_type, 'view'), 'none') WHEN 'click' THEN 'tap' ELSE coalesce(nullif(event_type, 'view'), 'none') END AS kind FROM events WHERE nullif(user_id, 7) IS NOT NULL")
def na_ops(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"), F.nullif("user_id", F.lit(7)).alias("u"))
    return events.na.drop(subset=["u"]).na.fill({"kind": "none"}).na.replace({"click": "tap"}, subset=["kind"]).select("event_id", "kind")


@add("SELECT TRUE AS about_a_tenth, TRUE AS once, TRUE AS repeatable, TRUE AS may_repeat")
def sample_rows(spark, sf):
    orders = _orders(spark, sf).select("o_orderkey")
    got = orders.sample(withReplacement=False, fraction=0.1, seed=42)
    n, again = got.count(), orders.sample(withReplacement=False, fraction=0.1, seed=42)
    about = abs(n - 0.1 * orders.count()) <= 4 * (0.09 * orders.count()) ** 0.5
    twice = orders.sample(withReplacement=True, fraction=2.0, seed=1)
    checks = (about, got.distinct().count() == n, got.exceptAll(again).isEmpty(), twice.count() > twice.distinct().count())
    return spark.createDataFrame([checks], "about_a_tenth boolean, once boolean, repeatable boolean, may_repeat boolean")


@add("SELECT 'n_nationkey' AS name, 'int' AS kind UNION ALL SELECT 'n_name', 'string' UNION ALL SELECT 'n_regionkey', 'int'")
def schema_inspection(spark, sf):
    return spark.createDataFrame(table(spark, sf, "nation").dtypes, "name string, kind string")


@add("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def word_count(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@add("SELECT vec_id, (generate_subscripts(embedding[1:3], 1) - 1)::INTEGER AS pos, unnest(embedding[1:3]) AS x FROM embeddings")
def posexplode(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 3)).alias("pos", "x"))


@add("SELECT n_nationkey, x FROM nation LEFT JOIN (SELECT n_nationkey AS k, unnest(CASE WHEN n_regionkey = 0 THEN [] ELSE [n_name, 'z'] END) AS x FROM nation) ON k = n_nationkey")
def explode_outer(spark, sf):
    arr = F.when(F.col("n_regionkey") == 0, F.array().cast("array<string>")).otherwise(F.array("n_name", F.lit("z")))
    return table(spark, sf, "nation").select("n_nationkey", F.explode_outer(arr).alias("x"))


@add("SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS part FROM nation")
def lateral_view(spark, sf):
    return spark.sql("SELECT n_nationkey, part FROM {nation} LATERAL VIEW EXPLODE(split(n_name, 'A')) t AS part", nation=table(spark, sf, "nation"))


@add("SELECT r_name, n.n_name AS first_nation FROM region, LATERAL (SELECT min(n_name) AS n_name FROM nation WHERE n_regionkey = r_regionkey) n")
def lateral_join(spark, sf):
    return spark.sql(
        "SELECT r_name, n.n_name AS first_nation FROM {region}, LATERAL (SELECT min(n_name) AS n_name FROM {nation} WHERE n_regionkey = r_regionkey) n",
        region=table(spark, sf, "region"),
        nation=table(spark, sf, "nation"),
    )


@add("SELECT event_id, (props::JSON->>'k')::INTEGER AS k FROM events")
def variant_path(spark, sf):
    return spark.sql("SELECT event_id, variant_get(parse_json(props), '$.k', 'int') AS k FROM {events}", events=table(spark, sf, "events"))


@add("SELECT o_orderkey, o_totalprice * 1.5 AS gross FROM orders WHERE o_orderstatus = 'O'")
def transform_chain(spark, sf):
    def open_only(df: DataFrame) -> DataFrame:
        return df.where("o_orderstatus = 'O'")

    def gross(df: DataFrame, rate: float) -> DataFrame:
        return df.select("o_orderkey", (F.col("o_totalprice") * (1 + rate)).alias("gross"))

    return _orders(spark, sf).transform(open_only).transform(gross, 0.5)
