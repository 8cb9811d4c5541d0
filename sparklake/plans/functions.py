"""Scalar functions, by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklake.plans._registry import Registry, listed, table

QUERIES = Registry()
add = QUERIES.add


@add(
    """SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, length(p_name)::INTEGER AS len, trim('  ' || p_brand || ' ') AS tr, ltrim('  x ') AS lt, rtrim('  x ') AS rt, trim('**' || p_brand || '*', '*') AS bt,
    lpad(p_partkey::VARCHAR, 6, '0') AS lp, rpad(p_brand, 12, '.') AS rp, substr(p_type, 2, 4) AS sub, split_part(p_type, ' ', 1) AS before, split_part(p_type, ' ', 2) AS part2, p_brand || '-' || p_size AS con,
    concat_ws('|', p_brand, NULL, p_type) AS ws, len(string_split(p_type, ' '))::INTEGER AS pieces, regexp_replace(p_name, '[aeiou]', '', 'g') AS novowel, regexp_extract(p_brand, '(\\d+)', 1) AS digits,
    len(regexp_extract_all(p_name, 'a'))::INTEGER AS n_a, translate(p_brand, 'Bd', 'bD') AS tl, printf('%05d-%s', p_size, p_brand) AS fmt, repeat('ab', 3) AS rpt, reverse(p_brand) AS rev,
    contains(p_type, 'A') AS has, ends_with(p_type, 'L') AS ends FROM part"""
)
def fn_string(spark, sf):
    brand, name, kind = F.col("p_brand"), F.col("p_name"), F.col("p_type")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.lower(name).alias("lo"),
        F.upper(name).alias("up"),
        F.length(name).alias("len"),
        F.trim(F.concat(F.lit("  "), brand, F.lit(" "))).alias("tr"),
        F.ltrim(F.lit("  x ")).alias("lt"),
        F.rtrim(F.lit("  x ")).alias("rt"),
        F.btrim(F.concat(F.lit("**"), brand, F.lit("*")), F.lit("*")).alias("bt"),
        F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("lp"),
        F.rpad(brand, 12, ".").alias("rp"),
        F.substring(kind, 2, 4).alias("sub"),
        F.substring_index(kind, " ", 1).alias("before"),
        F.split_part(kind, F.lit(" "), F.lit(2)).alias("part2"),
        F.concat(brand, F.lit("-"), F.col("p_size").cast("string")).alias("con"),
        F.concat_ws("|", brand, F.lit(None), kind).alias("ws"),
        F.size(F.split(kind, " ")).alias("pieces"),
        F.regexp_replace(name, "[aeiou]", "").alias("novowel"),
        F.regexp_extract(brand, r"(\d+)", 1).alias("digits"),
        F.regexp_count(name, F.lit("a")).alias("n_a"),
        F.translate(brand, "Bd", "bD").alias("tl"),
        F.format_string("%05d-%s", "p_size", brand).alias("fmt"),
        F.repeat(F.lit("ab"), 3).alias("rpt"),
        F.reverse(brand).alias("rev"),
        F.contains(kind, F.lit("A")).alias("has"),
        F.endswith(kind, F.lit("L")).alias("ends"),
    )


@add("SELECT r_name, upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) AS title FROM region WHERE NOT contains(r_name, ' ')")
def fn_initcap(spark, sf):
    return table(spark, sf, "region").where("NOT contains(r_name, ' ')").select("r_name", F.initcap("r_name").alias("title"))


@add(
    """SELECT event_id, ts::DATE AS d, strptime('2024-01-31 10:20:30', '%Y-%m-%d %H:%M:%S') AS parsed, strptime('31/01/2024 10:20', '%d/%m/%Y %H:%M') AS parsed_by, strftime(ts, '%Y/%m') AS fmt, year(ts)::INTEGER AS y, month(ts)::INTEGER AS mo, day(ts)::INTEGER AS dom,
    (dayofweek(ts) + 1)::INTEGER AS dow, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi, second(ts)::INTEGER AS sec, weekofyear(ts)::INTEGER AS wk, (ts::DATE + 5)::DATE AS plus5, (ts::DATE - 5)::DATE AS minus5,
    (ts::DATE + INTERVAL 1 MONTH)::DATE AS next_month, datediff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS dd, last_day(ts::DATE)::DATE AS eom, date_trunc('month', ts)::DATE AS tr, date_trunc('hour', ts) AS hr,
    floor(epoch(ts))::BIGINT AS unix, strftime(make_timestamp(86400000000), '%Y-%m-%d %H:%M:%S') AS from_unix, ts + INTERVAL 90 MINUTE AS later, quarter(ts)::INTEGER AS q FROM events"""
)
def fn_datetime(spark, sf):
    ts, day = F.col("ts"), F.to_date("ts")
    return table(spark, sf, "events").select(
        "event_id",
        day.alias("d"),
        F.to_timestamp_ntz(F.lit("2024-01-31 10:20:30")).alias("parsed"),
        F.to_timestamp(F.lit("31/01/2024 10:20"), "dd/MM/yyyy HH:mm").cast("timestamp_ntz").alias("parsed_by"),
        F.date_format(ts, "yyyy/MM").alias("fmt"),
        F.year(ts).alias("y"),
        F.month(ts).alias("mo"),
        F.dayofmonth(ts).alias("dom"),
        F.dayofweek(ts).alias("dow"),
        F.hour(ts).alias("h"),
        F.minute(ts).alias("mi"),
        F.second(ts).alias("sec"),
        F.weekofyear(ts).alias("wk"),
        F.date_add(day, 5).alias("plus5"),
        F.date_sub(day, 5).alias("minus5"),
        F.add_months(day, 1).alias("next_month"),
        F.datediff(day, F.lit("2024-01-01").cast("date")).alias("dd"),
        F.last_day(day).alias("eom"),
        F.trunc(day, "month").alias("tr"),
        F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hr"),
        F.unix_timestamp(ts).alias("unix"),
        F.from_unixtime(F.lit(86400)).alias("from_unix"),
        (ts + F.make_dt_interval(mins=F.lit(90))).alias("later"),
        F.quarter(ts).alias("q"),
    )


@add("SELECT TRUE AS today_ok, TRUE AS now_ok, 1.5::DOUBLE AS months")
def fn_now(spark, sf):
    today, now = F.current_date(), F.current_timestamp()
    months = F.months_between(F.lit("2024-03-16").cast("date"), F.lit("2024-01-31").cast("date"))
    return spark.range(1).select((today == F.to_date(now)).alias("today_ok"), (now > F.lit("2024-01-01").cast("timestamp")).alias("now_ok"), F.round(months * 2, 0).cast("double").alias("m")).select("today_ok", "now_ok", (F.col("m") / 2).alias("months"))


@add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def fn_window(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@add(
    """SELECT event_id, abs(value - 50) AS ab, round(sqrt(value), 6) AS sq, round(pow(value, 2), 4) AS pw, round(exp(value / 100), 6) AS ex, round(ln(value + 1), 6) AS lg, round(log10(value + 1), 6) AS lg10, round(value, 0) AS ro,
    ceil(value)::BIGINT AS ce, floor(-value)::BIGINT AS fl, greatest(user_id, 50) AS gr, least(user_id, 50) AS le, bit_count(user_id)::INTEGER AS bits, user_id & 12 AS anded, value / nullif(nullif(user_id, 7), 0) AS div, user_id % 7 AS md FROM events"""
)
def fn_math(spark, sf):
    v, u = F.col("value"), F.col("user_id")
    return table(spark, sf, "events").select(
        "event_id",
        F.abs(v - 50).alias("ab"),
        F.round(F.sqrt(v), 6).alias("sq"),
        F.round(F.pow(v, F.lit(2)), 4).alias("pw"),
        F.round(F.exp(v / 100), 6).alias("ex"),
        F.round(F.log(v + 1), 6).alias("lg"),
        F.round(F.log10(v + 1), 6).alias("lg10"),
        F.round(v, 0).alias("ro"),
        F.ceil(v).alias("ce"),
        F.floor(-v).alias("fl"),
        F.greatest(u, F.lit(50)).alias("gr"),
        F.least(u, F.lit(50)).alias("le"),
        F.bit_count(u).alias("bits"),
        u.bitwiseAND(12).alias("anded"),
        F.try_divide(v, F.nullif(u, F.lit(7))).alias("div"),
        (u % 7).alias("md"),
    )


@add("SELECT user_id % 5 AS k, bit_and(event_id) AS b_and, bit_or(event_id) AS b_or, bit_xor(event_id) AS b_xor FROM events GROUP BY 1")
def fn_bit_aggregates(spark, sf):
    return table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("k")).agg(F.bit_and("event_id").alias("b_and"), F.bit_or("event_id").alias("b_or"), F.bit_xor("event_id").alias("b_xor"))


@add("SELECT NULL::INTEGER AS overflow, 5::INTEGER AS fine, NULL::DOUBLE AS by_zero")
def fn_try(spark, sf):
    return spark.range(1).select(F.try_add(F.lit(2147483647), F.lit(1)).alias("overflow"), F.try_add(F.lit(2), F.lit(3)).alias("fine"), F.try_divide(F.lit(1), F.lit(0)).alias("by_zero"))


@add("SELECT count(*) AS n, TRUE AS in_unit FROM events")
def fn_random(spark, sf):
    found = table(spark, sf, "events").select(F.rand(7).alias("r"), F.randn(7).alias("g"))
    return found.agg(F.count("g").alias("n"), ((F.min("r") >= 0) & (F.max("r") < 1)).alias("in_unit"))


@add(
    """SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS co, ifnull(nullif(user_id, 7), 0) AS nv, nullif(event_type, 'view') AS nu, isnan(value) AS na, nullif(event_type, 'view') IS NULL AS nl,
    CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS wh, TRY_CAST(event_type AS INTEGER) AS tc, try_strptime(event_type, '%Y-%m-%d') AS tt FROM events"""
)
def fn_null(spark, sf):
    kind = F.nullif("event_type", F.lit("view"))
    return table(spark, sf, "events").select(
        "event_id",
        F.coalesce(kind, F.lit("none")).alias("co"),
        F.nvl(F.nullif("user_id", F.lit(7)), F.lit(0)).alias("nv"),
        kind.alias("nu"),
        F.isnan("value").alias("na"),
        F.isnull(kind).alias("nl"),
        F.expr("if(value > 50, 'hi', 'lo')").alias("wh"),
        F.col("event_type").try_cast("int").alias("tc"),
        F.try_to_timestamp("event_type", F.lit("yyyy-MM-dd")).cast("timestamp_ntz").alias("tt"),
    )


@add(
    """WITH a AS (SELECT n_nationkey AS id, [n_regionkey, n_nationkey % 3, n_regionkey, 9] AS x, [9, 1] AS y FROM nation)
    SELECT id, list_contains(x, 2) AS has, len(x)::INTEGER AS size, array_to_string(list_sort(list_distinct(x)), ',') AS dis, array_to_string(list_sort(list_distinct(list_intersect(x, y))), ',') AS inter, array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS uni,
    array_to_string(list_sort(list_distinct(list_filter(x, lambda e: NOT list_contains(y, e)))), ',') AS exc, array_to_string(list_sort(x), ',') AS sorted, array_to_string(list_filter([id, NULL, 1], lambda e: e IS NOT NULL), ',') AS comp, array_to_string(list_append(y, 5), ',') AS app, array_to_string(list_prepend(5, y), ',') AS pre,
    array_to_string([9, 7, 1], ',') AS ins, array_to_string(flatten([x, y]), ',') AS flat, x[1] AS first, x[-1] AS last, array_to_string(x[2:3], ',') AS sl, list_position(x, 9)::BIGINT AS pos, array_to_string(list_reverse(y), ',') AS rev, list_max(x) AS mx FROM a"""
)
def fn_array(spark, sf):
    n = table(spark, sf, "nation")
    base = n.select(F.col("n_nationkey").alias("id"), F.array("n_regionkey", F.col("n_nationkey") % 3, "n_regionkey", F.lit(9)).alias("x"), F.array(F.lit(9), F.lit(1)).alias("y"))
    return base.select(
        "id",
        F.array_contains("x", 2).alias("has"),
        F.size("x").alias("size"),
        listed(F.sort_array(F.array_distinct("x"))).alias("dis"),
        listed(F.sort_array(F.array_intersect("x", "y"))).alias("inter"),
        listed(F.sort_array(F.array_union("x", "y"))).alias("uni"),
        listed(F.sort_array(F.array_except("x", "y"))).alias("exc"),
        listed(F.sort_array("x")).alias("sorted"),
        listed(F.array_compact(F.array("id", F.lit(None), F.lit(1)))).alias("comp"),
        listed(F.array_append("y", F.lit(5))).alias("app"),
        listed(F.array_prepend("y", F.lit(5))).alias("pre"),
        listed(F.array_insert("y", 2, F.lit(7))).alias("ins"),
        listed(F.flatten(F.array("x", "y"))).alias("flat"),
        F.element_at("x", 1).alias("first"),
        F.element_at("x", -1).alias("last"),
        listed(F.slice("x", 2, 2)).alias("sl"),
        F.array_position("x", 9).alias("pos"),
        listed(F.reverse("y")).alias("rev"),
        F.array_max("x").alias("mx"),
    )


@add(
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v)), 4) AS norm2, array_to_string(list_transform(embedding[1:3], lambda v: v > 0), ',') AS positive, len(list_filter(embedding, lambda v: v > 0))::INTEGER AS n_pos,
    len(list_filter(embedding, lambda v: v > 2)) > 0 AS any_large, len(list_filter(embedding, lambda v: v < 10)) = len(embedding) AS all_small FROM embeddings"""
)
def fn_hof(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.round(F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v), 4).alias("norm2"),
        listed(F.transform(F.slice("embedding", 1, 3), lambda v: v > 0)).alias("positive"),
        F.size(F.filter("embedding", lambda v: v > 0)).alias("n_pos"),
        F.exists("embedding", lambda v: v > 2).alias("any_large"),
        F.forall("embedding", lambda v: v < 10).alias("all_small"),
    )


@add("SELECT n_nationkey, n_name AS by_key, TRUE AS has, 1::INTEGER AS kept, 'name,region' AS keys FROM nation")
def fn_map(spark, sf):
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    kept = F.map_filter(m, lambda k, v: k == "name")
    return table(spark, sf, "nation").select("n_nationkey", m["name"].alias("by_key"), F.map_contains_key(m, "name").alias("has"), F.size(kept).alias("kept"), listed(F.sort_array(F.map_keys(m))).alias("keys"))


@add("SELECT n_nationkey, 'name' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation")
def fn_map_explode(spark, sf):
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", F.explode(m))


@add("SELECT event_id, props::JSON->>'k' AS got, props::JSON->>'k' AS tup, (props::JSON->>'k')::INTEGER AS parsed, '{\"u\":' || user_id || '}' AS made, NULL::INTEGER AS bad FROM events")
def fn_json(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").alias("got"),
        F.json_tuple("props", "k").alias("tup"),
        F.from_json("props", "k int")["k"].alias("parsed"),
        F.to_json(F.struct(F.col("user_id").alias("u"))).alias("made"),
        F.from_json(F.lit("{broken"), "k int")["k"].alias("bad"),
    ).drop("user_id")


@add("SELECT 'STRUCT<a: BIGINT, b: ARRAY<STRING>>' AS ddl")
def fn_schema_of_json(spark, sf):
    return spark.range(1).select(F.schema_of_json(F.lit('{"a": 1, "b": ["x"]}')).alias("ddl"))


@add("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def fn_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"))


@add("SELECT 3421780262::BIGINT AS crc, 3::BIGINT AS distinct_hashes, 5::BIGINT AS ids, 5::BIGINT AS uuids")
def fn_ids(spark, sf):
    """CRC-32 has a published check value; hashes, running ids and UUIDs only promise to tell rows apart."""
    made = table(spark, sf, "region").select(F.crc32(F.lit("123456789").cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("i"), F.uuid().alias("u"), F.hash("r_name").alias("h"), F.xxhash64("r_name").alias("x"))
    return made.agg(F.max("crc").alias("crc"), F.least(F.count_distinct("h"), F.count_distinct("x"), F.lit(3)).alias("distinct_hashes"), F.count_distinct("i").alias("ids"), F.count_distinct("u").alias("uuids"))
