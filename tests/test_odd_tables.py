"""Queries on small tables that the given ones don't stand for, against their SQL."""

import datetime
import os
import subprocess
import sys

import pytest

from sparklake import catalog
from tests import oracle

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def differing(spark, path, name):
    """(expected rows, rows) of a query over the Parquet tables in path; the SQL is read over just those."""
    con = oracle.duckdb.connect()
    for file in path.glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}/*.parquet'")
    return oracle.duckdb_rows(con, SQL[name]), oracle.spark_rows(QUERIES[name](spark, str(path)))


def test_moving_range_rounds_seconds(spark, tmp_path):
    start, week = datetime.datetime(2024, 1, 1), 518_400_000_000
    at = [0, 400_000, 500_000, 1_500_000, week + 499_999, week + 500_000, week + 600_000, week + 1_500_000, week + 2_500_001, None]
    rows = [(k, None if x is None else start + datetime.timedelta(microseconds=x), 1, "view", 0.0) for k, x in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    want, got = differing(spark, tmp_path, "win_moving_range")
    assert want == got


CUSTOMER = "c_custkey long, c_name string, c_nationkey int"
CLUSTER = """
import sys
from sparklake import catalog
from sparklake.session import get_session
from tests import oracle
path = sys.argv[1]
spark = get_session("cluster", "local-cluster[2,1,1024]", spark__checkpoint__dir=f"file://{path}/shared", spark__sql__warehouse__dir=f"{path}/warehouse", spark__executor__memory="600m")
want = oracle.duckdb_rows(oracle.connect("/root/testdata/sf0.001"), catalog.oracle_sql()["jdbc_round_trip"])
assert want == oracle.spark_rows(catalog.queries()["jdbc_round_trip"](spark, "/root/testdata/sf0.001"))
spark.stop()
"""


def test_jdbc_on_a_cluster(tmp_path):
    """Executors are processes of their own, which a database in the driver's memory doesn't reach."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]


@pytest.mark.parametrize("master", ["local[4]", "local-cluster[2,1,1024]"])
@pytest.mark.parametrize("rows", [[], [(0, "only", 1)], [(-5, 'quo"te, and comma', 1), (7, "", None), (8, None, 3), (None, " lines\nof text ", 2), (9, '"', 0), (2**62, "\u4e16\u754c", -1)]])
def test_jdbc_odd_rows(spark, tmp_path, monkeypatch, rows, master):
    monkeypatch.setattr(spark.sparkContext, "master", master)
    spark.createDataFrame(rows, CUSTOMER).write.parquet(str(tmp_path / "customer.parquet"))
    want, got = differing(spark, tmp_path, "jdbc_round_trip")
    assert want == got


ORDERS = "o_orderkey long, o_totalprice double"


@pytest.mark.parametrize("rows", [[], [(5, 1.0)], [(3, 200000.0), (3, 5.0), (None, None), (4, float("nan")), (1, 100000.0)]])
def test_actions_odd_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, ORDERS).write.parquet(str(tmp_path / "orders.parquet"))
    want, got = differing(spark, tmp_path, "actions")
    assert want == got


def test_actions_bring_few_rows_to_the_driver(spark, tmp_path, monkeypatch):
    spark.range(50_000).selectExpr("id AS o_orderkey", "double(id) AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    frame, brought = type(spark.range(1)), []

    def watched(name):
        plain = getattr(frame, name)

        def run(self, *args, **kwargs):
            out = plain(self, *args, **kwargs)
            out = out if hasattr(out, "__len__") else list(out)
            brought.append(len(out))
            return out if name == "toPandas" else iter(out)

        monkeypatch.setattr(frame, name, run)

    for name in ("toLocalIterator", "toPandas"):
        watched(name)
    want, got = differing(spark, tmp_path, "actions")
    assert want == got and len(brought) == 2 and max(brought) <= 64
