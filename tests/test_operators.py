"""Composed operators: equal to the plain form, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from sparklake.operators import dedup, skew, temporal
from sparklake.quality import rules as dq


@pytest.fixture(scope="module")
def sides(spark):
    big = spark.range(2000).select("id", F.when(F.col("id") % 10 < 8, F.lit(7)).when(F.col("id") % 10 == 8, None).otherwise(F.col("id") % 50).cast("long").alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    return big, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_joins_equal_the_plain_one(sides, how):
    big, small = sides
    want = sorted(map(str, big.join(small, "k", how).collect()))
    assert sorted(map(str, skew.salted_join(big, small, "k", ("id",), how=how).collect())) == want
    assert sorted(map(str, skew.selective_salted_join(big, small, "k", ("id",), how=how).collect())) == want
    if how == "inner":
        assert sorted(map(str, skew.hot_split_join(big, small, "k", ("id",)).collect())) == want


def test_salted_joins_refuse_full_outer(sides):
    with pytest.raises(ValueError):
        skew.salted_join(*sides, "k", ("id",), how="full")


def test_hot_keys_are_few(sides):
    assert {r.k for r in skew.hot_keys(sides[0], "k", 0.1).collect()} == {7, None}


def test_broadcast_join_has_no_shuffle_of_the_big_side(spark, sides):
    big, small = sides
    plan = big.join(F.broadcast(small), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 45").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_bucketed_range_join_edges(spark):
    points = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 9.99, 10.0, 20.0, -5.0, None])], "id long, x double")
    ranges = spark.createDataFrame([(1, 0.0, 10.0), (2, 10.0, 10.0), (3, -7.5, 35.0), (4, 5.0, 1.0), (5, None, 3.0)], "r long, lo double, hi double")
    want = sorted(map(tuple, points.join(ranges, F.col("x").between(F.col("lo"), F.col("hi"))).select("id", "r").collect()))
    assert sorted(map(tuple, temporal.range_join(points, ranges, "x", "lo", "hi", 4).select("id", "r").collect())) == want


def test_asof_join_edges(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9), (5, "a", 3)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 5, "y"), ("a", 5, "z"), (None, 1, "n")], "k string, rt long, v string")
    got = {r.id: (r.rt, r.v) for r in temporal.asof_join(left, right, "k", "t", "rt", ("v",)).collect()}
    assert got == {1: (5, "z"), 2: (None, None), 3: (None, None), 4: (None, None), 5: (3, "x")}


def test_equal_gap_stays_in_the_session(spark):
    df = spark.createDataFrame([(i, "u", f"2024-01-01 00:{m:02d}:00") for i, m in enumerate([0, 30, 59])] + [(9, "u", "2024-01-01 01:29:01")], "id long, u string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.id: r.session for r in temporal.sessionize(df, "u", "t", 1800, "id").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 9: 2}


def test_content_hash_keeps_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a", "null", "b"), ("a|", "", "b")], "x string, y string, z string")
    assert df.select(dedup.content_hash("x", "y", "z")).distinct().count() == 4


def test_latest_forms_agree(spark):
    df = spark.createDataFrame([(i, i % 3, i * 7 % 11) for i in range(50)], "id long, k long, t long")
    want = sorted(map(tuple, dedup.latest(df, ["k"], F.desc("t"), "id").select("k", "id").collect()))
    assert sorted(map(tuple, dedup.latest_salted(df, ["k"], ("id",), F.desc("t"), "id").select("k", "id").collect())) == want
    assert sorted(map(tuple, dedup.latest_by_aggregate(df, ["k"], F.struct("t", -F.col("id"))).select("k", "id").collect())) == want


def test_quality_report(spark):
    df = spark.createDataFrame([(1, "a@b", 5.0, "EU"), (2, None, -1.0, "EU"), (3, "bad", 2.0, None), (4, "c@d", None, "XX")], "id long, email string, amount double, region string")
    rules = [dq.Rule("amount", "amount > 0"), dq.Rule("email", lambda d: d.email.rlike("@"), threshold=0.5), dq.Rule("region", "region IS NOT NULL", severity="warn"), dq.Rule("strict", "amount > 0", null_is_violation=True, severity="warn")]
    report = dq.run(df, rules)
    assert {r.name: (r.violations, r.passed) for r in report.results} == {"amount": (1, False), "email": (1, True), "region": (1, False), "strict": (2, False)}
    assert report.has_errors and report.has_warnings and '"rate": 0.25' in report.as_json()
    good, bad = dq.split(df, rules)
    assert sorted(r.id for r in good.collect()) == [1, 4]
    assert {r.id: r["_dq_reasons"] for r in bad.collect()} == {2: ["amount"], 3: ["email"]}
    assert not dq.run(df.limit(0), rules).has_errors and dq.row_count_within(df, 1, 4)
    assert dq.rules_from([{"name": "x", "predicate": "id > 0"}])[0].severity == "error"


def test_hot_split_join_salts_what_is_too_much_to_broadcast(sides, monkeypatch):
    big, small = sides
    many = small.union(small).union(small)
    want = sorted(map(str, big.join(many, "k").collect()))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 2)
    assert sorted(map(str, skew.hot_split_join(big, many, "k", ("id",)).collect())) == want


@pytest.mark.parametrize("alpha", [0.05, 0.3, 0.999])
@pytest.mark.parametrize("slices", [None, "floor(_t / 100)"])
def test_exponential_mean_is_a_fold(spark, alpha, slices):
    r = random.Random(4)
    rows = [(i, r.choice(["hot", "hot", "hot", "a", None]), i // 3, None if r.random() < 0.2 else r.uniform(-50, 100)) for i in range(2500)]
    rows += [(5000 + i, "late", i, None if i < 150 else float(i)) for i in range(400)] + [(9000, "none", 1, None)]
    mean, want = {}, {}
    for i, k, t, v in sorted(rows, key=lambda x: (x[2], x[0])):
        if v is not None:
            mean[k] = v if mean.get(k) is None else alpha * v + (1 - alpha) * mean[k]
        want[i] = mean.get(k)
    df = spark.createDataFrame(rows, "i long, k string, t long, v double")
    got = {x.i: x.m for x in temporal.exponential_mean(df, "k", ["t", "i"], "v", alpha, "m", slices).collect()}
    assert got.keys() == want.keys()
    assert all((got[i] is None) == (w is None) and (w is None or abs(got[i] - w) < 1e-9 * max(1, abs(w))) for i, w in want.items())
    with pytest.raises(ValueError, match="alpha"):
        temporal.exponential_mean(df, "k", ["t"], "v", 1.0)
