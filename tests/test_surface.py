"""Sketches, row sinks, connectors' options, functions and jobs beyond the oracles."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from sparklake import inspection
from sparklake.functions import tables as tf
from sparklake.operators import sketches
from sparklake.pipelines import orders
from sparklake.sources import rows as sinks
from sparklake.streaming import monitor
from sparklake.streaming.sinks import RowWriter


@pytest.fixture(scope="module")
def skewed(spark):
    r = random.Random(2)
    values = [int(r.paretovariate(0.7)) % 5000 for _ in range(6000)] + [None] * 200
    return values, spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long")


def test_count_min_bounds(skewed):
    values, df = skewed
    counts = collections.Counter(v for v in values if v is not None)
    asked = df.select("v").distinct().where("v IS NOT NULL")
    got = {r.v: r.estimate for r in sketches.count_min_estimate(sketches.count_min(df, "v", 256, 4), asked, "v", 256, 4).collect()}
    assert got.keys() == counts.keys() and all(got[v] >= n for v, n in counts.items())
    assert sum(got[v] > n + 2.72 / 256 * 6000 for v, n in counts.items()) <= 0.03 * len(counts)


@pytest.mark.parametrize("k", [1, 7, 100_000])
@pytest.mark.parametrize("slots", [1, 16, 4096])
def test_heavy_hitters_are_exact(skewed, k, slots):
    values, df = skewed
    counts = collections.Counter(v for v in values if v is not None)
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    assert [tuple(r) for r in sketches.heavy_hitters(df, "v", k, slots).collect()] == want


def test_bloom_filter_loses_nothing(spark, skewed):
    _, df = skewed
    keys = spark.range(0, 5000, 3).select(F.col("id").cast("int").alias("k"))
    maybe = sketches.bloom_filter(df, "v", *sketches.bloom(keys, "k", 1667))
    want = {r.i for r in df.where("v % 3 = 0").collect()}
    got = [r.i for r in maybe.collect()]
    assert want <= set(got) and len(got) == len(set(got)) and len(got) <= len(want) + 0.1 * 6200
    assert sketches.bloom_filter(df, "v", *sketches.bloom(keys.limit(0), "k", 0)).isEmpty()


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "i long, v long")
    assert sketches.heavy_hitters(none, "v", 3).collect() == [] and sketches.reservoir(none, ["i"], 3).collect() == []
    assert sketches.count_min(none, "v").collect() == []


def test_jdbc_options():
    got = sinks.jdbc_options("jdbc:x", "t", partition_column="id", lower=0, upper=9, partitions=3, isolation="SERIALIZABLE", driver="d")
    assert got == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "10000", "batchsize": "10000", "isolationLevel": "SERIALIZABLE", "driver": "d", "partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}
    for bad in ({"partition_column": "id"}, {"lower": 1, "upper": 2}, {"partition_column": "id", "lower": 5, "upper": 5, "partitions": 2}, {"isolation": "LOOSE"}):
        with pytest.raises(ValueError):
            sinks.jdbc_options("jdbc:x", "t", **bad)


def test_kafka_options():
    got = sinks.kafka_options("a:9092", subscribe="t1,t2", starting={"t1": {0: 5, 1: -2}}, per_trigger=100)
    assert json.loads(got["startingOffsets"]) == {"t1": {"0": 5, "1": -2}} and got["maxOffsetsPerTrigger"] == "100" and got["failOnDataLoss"] == "true"
    assert json.loads(sinks.kafka_options("a", assign={"t": [0, 2]}, starting="earliest", ending="latest")["assign"]) == {"t": [0, 2]}
    for bad in ({}, {"subscribe": "t", "pattern": "t.*"}, {"subscribe": "t", "ending": "earliest"}, {"subscribe": "t", "ending": "latest", "per_trigger": 5}):
        with pytest.raises(ValueError):
            sinks.kafka_options("a", **bad)


def test_row_writer_sends_in_parts_and_nothing_after_a_failure():
    sent = []
    writer = RowWriter(lambda rows, p, e: sent.append((list(rows), p, e)), 2)
    assert writer.open(3, 7)
    for x in "abc":
        writer.process(x)
    writer.close(None)
    assert sent == [(["a", "b"], 3, 7), (["c"], 3, 7)]
    writer.open(0, 8)
    writer.process("d")
    writer.close(RuntimeError())
    assert len(sent) == 2


def test_table_function_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "a  b\tc"), (2, ""), (3, None)], "i int, t string")
    spark.udtf.register("split_words", tf.SplitWords)
    got = spark.sql("SELECT i, s.* FROM {df}, LATERAL split_words(t) s", df=df).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")]


def test_inspection(spark):
    with pytest.raises(ValueError):
        inspection.plan_text(spark.range(3), "pretty")
    assert sorted(inspection.partition_sizes(spark.range(10).repartition(3))) == [3, 3, 4]


def test_state_store_setting_is_restored(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with monitor.state_store(spark, "rocksdb"):
        assert spark.conf.get(key).endswith("RocksDBStateStoreProvider")
    assert spark.conf.get(key, None) == before


def test_job_arguments(capsys):
    config = orders.Config.from_args(["--root", "/r", "--env", "prod", "--source", "/in", "--batch-date", "2024-02-29"])
    assert config.table("silver") == "/r/prod/silver" and config.batch_id == "manual" and orders.Config("/r").table("gold") == "/r/gold"
    for bad in (["--root", "/r"], ["--root", "/r", "--source", "x", "--batch-date", "2024-02-30"], ["--root", "/r", "--env", "moon", "--source", "x", "--batch-date", "2024-02-01"]):
        with pytest.raises(SystemExit):
            orders.Config.from_args(bad)
