"""Sketches, actions, row sinks, table functions, inspection, and what streams offer besides their rows."""

from __future__ import annotations

import http.server
import json
import os
import threading
import uuid

from pyspark.sql import functions as F

from sparklake import inspection
from sparklake.functions import tables as tf
from sparklake.operators import sketches
from sparklake.plans._registry import Registry, table
from sparklake.plans.streams import _EVENT, _events, _landed, _stream
from sparklake.session import scratch_path
from sparklake.sources import rows as row_sinks
from sparklake.streaming import monitor, sinks, stateful

QUERIES = Registry()
add = QUERIES.add


def _users(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id")


# -- sketches


@add("SELECT count(DISTINCT user_id) AS users, TRUE AS never_under, TRUE AS close FROM events")
def sketch_count_min(spark, sf):
    events = _users(spark, sf)
    half = F.col("event_id") % 2 == 0
    merged = sketches.count_min_merge(sketches.count_min(events.where(half), "user_id"), sketches.count_min(events.where(~half), "user_id"))
    found = sketches.count_min_estimate(merged, events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    total = events.agg(F.count("*").alias("total"))
    far = F.col("estimate") > F.col("n") + 2.72 / 4096 * F.col("total") + 1
    return found.crossJoin(F.broadcast(total)).agg(F.count("*").alias("users"), (F.min((F.col("estimate") >= F.col("n")).cast("int")) == 1).alias("never_under"), (F.avg(far.cast("int")) <= 0.05).alias("close"))


@add("SELECT o_orderkey, TRUE AS few FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def sketch_bloom(spark, sf):
    """A Bloom filter of one side takes most of the other out of the join."""
    keys = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    maybe = sketches.bloom_filter(orders, "o_custkey", *sketches.bloom(keys, "c_custkey", keys.count(), 0.001))
    exact = maybe.join(keys, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    few = maybe.count() <= 1.05 * exact.count()
    return exact.select("o_orderkey", F.lit(few).alias("few"))


@add("SELECT 100::BIGINT AS n, 100::BIGINT AS distinct_rows, TRUE AS spread, TRUE AS merges")
def sketch_reservoir(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    whole = sketches.reservoir(events, ["event_id"], 100)
    half = F.col("event_id") % 2 == 0
    parts = sketches.reservoir(events.where(half), ["event_id"], 100).union(sketches.reservoir(events.where(~half), ["event_id"], 100))
    again = sketches.reservoir(parts, ["event_id"], 100)
    same = whole.join(again, "event_id", "left_semi").agg((F.count("*") == 100).alias("merges"))
    middle = events.agg(F.avg("event_id").alias("mean"))
    low = whole.crossJoin(middle).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_rows"), F.count_if(F.col("event_id") < F.col("mean")).between(20, 80).alias("spread"))
    return low.crossJoin(same)


@add("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def sketch_heavy_hitters(spark, sf):
    return sketches.heavy_hitters(_users(spark, sf), "user_id", 10, 64)


# -- actions, row sinks and connectors


@add("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total, count(*) AS by_foreach, count_if(o_totalprice > 100000)::BIGINT AS dear, min(o_orderkey) AS first_key, count(*) AS pandas_rows FROM orders")
def actions(spark, sf):
    """Sums, counts and first rows come to the driver; the rows themselves are read by the executors."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("p"))
    sums = orders.where("o_orderkey IS NOT NULL").groupBy(F.pmod(F.hash("o_orderkey"), F.lit(64)).alias("part")).agg(F.sum("o_orderkey").alias("s"))
    sums = [r.s for r in sums.toLocalIterator()]  # 64 at most
    total = sum(sums) if sums else None
    rows, dear = tf.counted_rows(orders, lambda r: r.p is not None and not r.p <= 100000)  # as in SQL, NaN is above all
    ordered = orders.orderBy(F.asc_nulls_last("o_orderkey"))
    taken = [r.o_orderkey for r in ordered.take(2)]
    first = taken[0] if taken else None
    if taken:
        assert first == ordered.first().o_orderkey == ordered.head(1)[0].o_orderkey

    def sizes(frames):
        for f in frames:
            yield f[["count"]].sum().to_frame("n")

    counted = orders.groupBy("o_orderkey").count().mapInPandas(sizes, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).toPandas()
    counted = int(counted["n"].iloc[0])
    return spark.createDataFrame([(orders.count(), total, rows, dear if rows else None, first, counted)], "n long, total long, by_foreach long, dear long, first_key long, pandas_rows long")


@add("SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation")
def rest_sink(spark, sf):
    """Rows POSTed by the executors to a server of this process, which counts a repeated batch once; for local masters."""
    got: dict[str, list[dict]] = {}

    class Receiver(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            got[self.headers["Idempotency-Key"]] = [json.loads(x) for x in body.splitlines()]
            self.send_response(200)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
        for _ in range(2):
            row_sinks.post_rows(nation, f"http://127.0.0.1:{server.server_address[1]}/", 10)
    finally:
        server.shutdown()
    keys = [r["n_nationkey"] for batch in got.values() for r in batch]
    return spark.createDataFrame([(len(keys), sum(keys))], "n long, total long")


@add("SELECT c_custkey, c_name, c_nationkey FROM customer")
def jdbc_round_trip(spark, sf):
    """Written through a few connections (on a cluster, by bulk import), read in eight partitions of the key; the database is an embedded one."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    url = row_sinks.embedded_database(rows, scratch_path(spark, "derby"), "customers", 2)
    top = rows.agg(F.max("c_custkey")).first()[0]
    found = row_sinks.read_jdbc(spark, url, "customers", partition_column="c_custkey", lower=0, upper=max(top or 0, 1), partitions=8, driver=row_sinks.DERBY)
    return found.select(*[F.col(f.name).alias(f.name.lower()) for f in found.schema]).select("c_custkey", "c_name", "c_nationkey")


# -- functions


@add("SELECT p_partkey, generate_subscripts(w, 1)::INTEGER AS position, unnest(w) AS word FROM (SELECT p_partkey, string_split_regex(trim(p_name), '\\s+') AS w FROM part)")
def udtf_words(spark, sf):
    spark.udtf.register("split_words", tf.SplitWords)
    return spark.sql("SELECT p_partkey, s.position, s.word FROM {part}, LATERAL split_words(p_name) s", part=table(spark, sf, "part"))


@add("SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def udf_broadcast_lookup(spark, sf):
    names = {r.n_nationkey: r.n_name for r in table(spark, sf, "nation").collect()}  # 25 rows
    return table(spark, sf, "customer").select("c_custkey", tf.lookup(spark, names)("c_nationkey").alias("nation"))


@add("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def pandas_on_spark(spark, sf):
    import pyspark.pandas as ps

    held = ps.get_option("compute.default_index_type")
    ps.set_option("compute.default_index_type", "distributed")
    try:
        c = ps.read_parquet(f"{sf}/customer.parquet")[["c_mktsegment", "c_acctbal"]]
        found = c.groupby("c_mktsegment").agg({"c_acctbal": ["count", "mean"]})
        found.columns = ["n", "mean"]
        return found.reset_index().to_spark().select("c_mktsegment", F.col("n").cast("long").alias("n"), F.round("mean", 4).alias("mean"))
    finally:
        ps.set_option("compute.default_index_type", held)


# -- inspection


@add("SELECT * FROM (VALUES ('simple', TRUE), ('extended', TRUE), ('codegen', TRUE), ('cost', TRUE), ('formatted', TRUE)) t(mode, shows)")
def explain_modes(spark, sf):
    df = table(spark, sf, "orders").where("o_totalprice > 1000").groupBy("o_orderstatus").count()
    marks = {"simple": "== Physical Plan ==", "extended": "== Optimized Logical Plan ==", "codegen": "WholeStageCodegen subtrees", "cost": "Statistics(sizeInBytes", "formatted": "PushedFilters"}
    return spark.createDataFrame([(m, mark in inspection.plan_text(df, m)) for m, mark in marks.items()], "mode string, shows boolean")


@add("SELECT 'spark.sql.shuffle.partitions' AS name, TRUE AS runtime UNION ALL SELECT 'spark.sql.warehouse.dir', FALSE UNION ALL SELECT 'spark.executor.memory', FALSE")
def conf_runtime(spark, sf):
    found = inspection.runtime_settings(spark, "spark.sql.shuffle.partitions", "spark.sql.warehouse.dir", "spark.executor.memory")
    return spark.createDataFrame(list(found.items()), "name string, runtime boolean")


@add("SELECT 6::BIGINT AS parts, count(*) AS n, TRUE AS shuffled FROM orders")
def partition_lineage(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey").repartition(6)
    sizes = inspection.partition_sizes(orders)
    return spark.createDataFrame([(orders.rdd.getNumPartitions(), sum(sizes), "ShuffledRowRDD" in inspection.lineage(orders))], "parts long, n long, shuffled boolean")


@add("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def rdd_key_join(spark, sf):
    """A join of pairs, as RDDs do it; DataFrames are the plain way."""
    nation = table(spark, sf, "nation").select("n_regionkey", "n_name").rdd.map(tuple)
    region = table(spark, sf, "region").select("r_regionkey", "r_name").rdd.map(tuple)
    return spark.createDataFrame(nation.join(region).values(), "n_name string, r_name string")


# -- streams


@add("SELECT count(*) AS input_rows, 2::BIGINT AS batches, 5::BIGINT AS state_rows, TRUE AS stopped, TRUE AS well FROM events")
def stream_progress(spark, sf):
    e = _events(spark, sf)
    counts = _stream(spark, e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")).groupBy("event_type").count()
    query = sinks.start(counts, scratch_path(spark, "ck"), "noop", "complete")
    well = monitor.failure(query) is None
    p = monitor.progress(query)
    return spark.createDataFrame([(p["input_rows"], p["batches"], p["state_rows"], not p["active"], well)], "input_rows long, batches long, state_rows long, stopped boolean, well boolean")


@add("SELECT TRUE AS told, TRUE AS restarted, count(*) AS n FROM events")
def stream_failure(spark, sf):
    """A failing batch ends the query with its message; a restart from the checkpoint takes that batch again and loses nothing."""
    path, ck, out = _landed(spark, _events(spark, sf), kind="parquet"), scratch_path(spark, "ck"), scratch_path(spark, "out")

    def run(broken):
        def write(batch, batch_id):
            if broken:
                raise RuntimeError("no space left")
            batch.write.mode("overwrite").parquet(f"{out}/{batch_id}")

        return sinks.file_stream(spark, path, _EVENT, "parquet").writeStream.foreachBatch(write).option("checkpointLocation", ck).trigger(availableNow=True).start()

    message = monitor.failure(run(True)) or ""
    well = monitor.failure(run(False)) is None
    return spark.read.parquet(f"{out}/*").agg(F.lit("no space left" in message).alias("told"), F.lit(well).alias("restarted"), F.count("*").alias("n"))


@add(
    """SELECT * FROM (VALUES ('projection', 'append,update'), ('aggregate', 'update,complete'), ('windowed', 'append,update,complete'), ('dedup', 'append,update'), ('inner join', 'append'), ('outer join', 'append')) t(kind, modes)"""
)
def stream_modes(spark, sf):
    """Which output modes a plan may have."""
    rates = lambda: spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    marked = lambda: rates().withWatermark("timestamp", "1 minute")
    right = marked().select(F.col("timestamp").alias("t2"), F.col("value").alias("v2"))
    on = (F.col("value") == F.col("v2")) & (F.col("t2") >= F.col("timestamp")) & (F.col("t2") <= F.col("timestamp") + F.expr("INTERVAL 1 MINUTE"))
    plans = {
        "projection": rates().select("value"),
        "aggregate": rates().groupBy((F.col("value") % 2).alias("k")).count(),
        "windowed": marked().groupBy(F.window("timestamp", "1 minute")).count(),
        "dedup": marked().dropDuplicates(["value", "timestamp"]),
        "inner join": marked().join(right, on),
        "outer join": marked().join(right, on, "left_outer"),
    }
    return spark.createDataFrame([(k, ",".join(monitor.allowed_modes(p))) for k, p in plans.items()], "kind string, modes string")


@add("SELECT 'every' AS trigger, count(*) AS n FROM events UNION ALL SELECT 'available now', count(*) FROM events UNION ALL SELECT 'table', count(*) FROM events UNION ALL SELECT 'memory', 5")
def stream_triggers(spark, sf):
    """One stream by each trigger, into files, a catalog table and memory."""
    e = _events(spark, sf)
    path = _landed(spark, e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), kind="parquet")
    stream = lambda: sinks.file_stream(spark, path, _EVENT, "parquet", files_per_trigger=1)
    every, now = scratch_path(spark, "every"), scratch_path(spark, "now")
    query = sinks.start(stream(), scratch_path(spark, "ck"), "parquet", every="50 milliseconds", path=every)
    query.processAllAvailable()
    query.stop()
    sinks.finish(sinks.start(stream(), scratch_path(spark, "ck"), "parquet", path=now))
    name = f"sparklake_stream_{uuid.uuid4().hex}"
    sinks.finish(sinks.start(stream(), scratch_path(spark, "ck"), table=name))
    kept = f"counts_{uuid.uuid4().hex}"
    sinks.finish(sinks.start(stream().groupBy("event_type").count(), scratch_path(spark, "ck"), "memory", "complete", name=kept))
    count = lambda df, trigger: df.agg(F.lit(trigger).alias("trigger"), F.count("*").alias("n"))
    parts = [count(spark.read.schema(_EVENT).parquet(every), "every"), count(spark.read.schema(_EVENT).parquet(now), "available now"), count(spark.table(name), "table"), count(spark.table(kept), "memory")]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@add("SELECT event_id FROM events WHERE event_type = 'click'")
def stream_foreach(spark, sf):
    """A row writer on the executors: one file for each partition of each batch, replaced if the batch is tried again."""
    folder = scratch_path(spark, "rows").split("file:")[-1]

    def send(rows, partition, epoch):
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{epoch}-{partition}-{rows[0].event_id}.json", "w") as f:
            f.writelines(json.dumps({"event_id": r.event_id}) + "\n" for r in rows)

    e = _events(spark, sf)
    stream = _stream(spark, e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")).where("event_type = 'click'").select("event_id")
    sinks.each_row(stream, sinks.RowWriter(send, 500), scratch_path(spark, "ck"))
    return spark.read.schema("event_id long").json(folder)


@add(
    """SELECT a.event_id, b.event_id AS clicked, c.event_id AS bought FROM (SELECT * FROM events WHERE event_type = 'view') a JOIN (SELECT * FROM events WHERE event_type = 'click') b
    ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 24 HOUR JOIN (SELECT * FROM events WHERE event_type = 'purchase') c ON a.user_id = c.user_id AND c.ts BETWEEN b.ts AND b.ts + INTERVAL 24 HOUR"""
)
def stream_multiway_join(spark, sf):
    """View, click and purchase of a user, each within a day of the one before, with the state in RocksDB."""
    e = _events(spark, sf)

    def side(kind, k):
        names = {} if k == 0 else {"user_id": f"user_id_{k}", "event_id": f"event_id_{k}", "ts": f"ts_{k}"}
        return _stream(spark, e.where(F.col("event_type") == kind)).select("event_id", "user_id", "ts").withColumnsRenamed(names)

    joined = stateful.chain_join([side("view", 0), side("click", 1), side("purchase", 2)], "user_id", ["ts", "ts_1", "ts_2"], "40 days", "24 hours")
    with monitor.state_store(spark, "rocksdb"):
        return sinks.collected(joined.select("event_id", F.col("event_id_1").alias("clicked"), F.col("event_id_2").alias("bought")))
