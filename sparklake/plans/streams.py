"""Streams over the events, run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklake.pipelines import clickstream
from sparklake.plans._registry import Registry, table
from sparklake.session import scratch_path
from sparklake.streaming import sinks, source, stateful
from sparklake.table import VersionedTable

QUERIES = Registry()
add = QUERIES.add
_EVENT = "event_id long, user_id long, event_type string, value double, ts timestamp"
#: After all others: it moves the watermark, so every window before it closes. Take it out after the stream only: Spark pushes filters
#: below the watermark.
_SENTINEL = "SELECT -1L AS event_id, -1L AS user_id, 'end' AS event_type, 0D AS value, TIMESTAMP '2030-01-01' AS ts"


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def _landed(spark, *batches, kind="json"):
    """A folder with one file for each batch, in order of time."""
    path = scratch_path(spark, "landing")
    for batch in batches:
        batch.coalesce(1).write.mode("append").format(kind).save(path)
    return path


def _stream(spark, *batches):
    return sinks.file_stream(spark, _landed(spark, *batches, kind="parquet"), _EVENT, "parquet", files_per_trigger=1)


def _ntz(df):
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"})


@add("SELECT event_id, upper(event_type) AS kind, value * 2 AS twice FROM events WHERE event_type <> 'error'")
def stream_file_append(spark, sf):
    e = _events(spark, sf)
    stream = _stream(spark, e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")).where("event_type <> 'error'").select("event_id", F.upper("event_type").alias("kind"), (F.col("value") * 2).alias("twice"))
    t = VersionedTable.create(spark, scratch_path(spark, "sink"), "event_id long, kind string, twice double")
    sinks.to_table(stream, t, "append", scratch_path(spark, "ck"))
    return t.to_df()


@add("SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def stream_file_sink(spark, sf):
    stream = sinks.file_stream(spark, _landed(spark, _events(spark, sf)), _EVENT)
    return sinks.collected(stream.where("event_type = 'click'").select("event_id", "event_type"))


@add("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_complete_counts(spark, sf):
    e = _events(spark, sf)
    return sinks.collected(_stream(spark, e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@add("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_watermark_late(spark, sf):
    """Rows later than the watermark are dropped: the second file repeats the first day after the watermark has passed it."""
    e = _events(spark, sf)
    late = e.where("ts < TIMESTAMP '2024-01-02'")
    found = sinks.collected(stateful.windowed_counts(_stream(spark, e, spark.sql(_SENTINEL), late), "ts", "1 hour", "1 day", None, "event_type"))
    return _ntz(found.where("event_type <> 'end'")).select("window_start", "event_type", "n")


@add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def window_tumbling(spark, sf):
    found = _events(spark, sf).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return _ntz(found.select(F.col("w.start").alias("window_start"), "n", "total"))


@add("SELECT s AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1")
def window_sliding(spark, sf):
    found = _events(spark, sf).groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return _ntz(found.select(F.col("w.start").alias("window_start"), "n"))


_SESSIONS = """(WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, session, min(ts) AS session_start, max(ts) AS session_end, count(*) AS event_count, count(DISTINCT event_type)::INTEGER AS event_type_count FROM i GROUP BY 1, 2)"""


@add(f"SELECT user_id, session_start, session_end, event_count, event_type_count FROM {_SESSIONS}")
def window_session(spark, sf):
    found = _events(spark, sf).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.max("ts").alias("session_end"), F.count("*").alias("event_count"), F.count_distinct("event_type").cast("int").alias("event_type_count"))
    return _ntz(found.select("user_id", F.col("w.start").alias("session_start"), "session_end", "event_count", "event_type_count"))


@add(f"SELECT user_id, session_start, session_end, event_count, event_type_count FROM {_SESSIONS}")
def stream_sessions(spark, sf):
    found = sinks.collected(stateful.session_counts(_stream(spark, _events(spark, sf), spark.sql(_SENTINEL)), "ts", "1 hour", "30 minutes", "user_id", "event_type"))
    return _ntz(found.where("user_id >= 0")).select("user_id", "session_start", "session_end", "event_count", "event_type_count")


@add(f"SELECT user_id, round(epoch(session_start), 3) AS session_start, round(epoch(session_end), 3) AS session_end, event_count AS n FROM {_SESSIONS}")
def stream_custom_session(spark, sf):
    e = _events(spark, sf)
    stream = _stream(spark, e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), spark.sql(_SENTINEL))
    found = sinks.collected(stateful.custom_sessions(stream, "user_id", "ts", "40 days", 1800))
    return found.where("user_id >= 0").select("user_id", F.round("session_start", 3).alias("session_start"), F.round("session_end", 3).alias("session_end"), "n")


@add("SELECT event_id FROM events")
def stream_dedup(spark, sf):
    e = _events(spark, sf)
    return sinks.collected(stateful.first_seen(_stream(spark, e, e.where("event_id % 3 = 0")), "ts", "40 days", "event_id").select("event_id"))


@add("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE c_custkey % 2 = 0")
def stream_static_join(spark, sf):
    users = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    return sinks.collected(_stream(spark, _events(spark, sf)).join(users, "user_id").select("event_id", "c_name"))


_PAIRS = "FROM (SELECT * FROM events WHERE event_type = 'click') a {} JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR"


def _clicks_and_purchases(spark, sf):
    e = _events(spark, sf)
    end = spark.sql(_SENTINEL)
    clicks = _stream(spark, e.where("event_type = 'click'"), end, end)
    bought = _stream(spark, e.where("event_type = 'purchase'"), end, end).select(F.col("user_id").alias("right_user_id"), F.col("event_id").alias("bought"), F.col("ts").alias("bought_at"))
    return clicks, bought


@add(f"SELECT a.event_id, b.event_id AS bought {_PAIRS.format('')}")
def stream_stream_join(spark, sf):
    clicks, bought = _clicks_and_purchases(spark, sf)
    return sinks.collected(stateful.interval_join(clicks, bought, "user_id", "ts", "bought_at", "40 days", "1 hour").select("event_id", "bought")).where("event_id >= 0")


@add(f"SELECT a.event_id, b.event_id AS bought {_PAIRS.format('LEFT')}")
def stream_stream_left(spark, sf):
    clicks, bought = _clicks_and_purchases(spark, sf)
    return sinks.collected(stateful.interval_join(clicks, bought, "user_id", "ts", "bought_at", "1 hour", "1 hour", "left").select("event_id", "bought")).where("event_id >= 0")


@add("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def stream_foreachbatch_merge(spark, sf):
    e = _events(spark, sf)
    stream = _stream(spark, e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")).select("user_id", "event_id", "value", "ts")
    t = VersionedTable.create(spark, scratch_path(spark, "users"), "user_id long, event_id long, value double, ts timestamp")
    sinks.upsert(stream, t, ["user_id"], ["ts", "event_id"], scratch_path(spark, "ck"))
    return t.to_df().select("user_id", "event_id", "value")


@add("SELECT count(*) AS n, count(*) AS ids FROM events")
def stream_replay_idempotent(spark, sf):
    """The same files with a lost checkpoint: batch 0 comes again and is recognised."""
    path = _landed(spark, _events(spark, sf))
    t = VersionedTable.create(spark, scratch_path(spark, "sink"), _EVENT)
    for _ in range(2):
        sinks.to_table(sinks.file_stream(spark, path, _EVENT), t, "replayed", scratch_path(spark, "ck"))
    return t.to_df().agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@add("SELECT 'good' AS kind, count_if(event_id % 9 <> 0)::BIGINT AS n FROM events UNION ALL SELECT 'dead', count_if(event_id % 9 = 0)::BIGINT FROM events")
def stream_dead_letter(spark, sf):
    line = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "user_id")))
    path = _landed(spark, table(spark, sf, "events").select(line.alias("value")), kind="text")
    stream = sinks.file_stream(spark, path, "value string", "text").withColumn("p", F.from_json("value", "event_id long, user_id long"))
    tables = {"good": VersionedTable.create(spark, scratch_path(spark, "good"), "event_id long, user_id long"), "dead": VersionedTable.create(spark, scratch_path(spark, "dead"), "value string")}
    routes = {"good": lambda b: b.where("p.event_id IS NOT NULL").select("p.*"), "dead": lambda b: b.where("p.event_id IS NULL").select("value")}
    sinks.fan_out(stream, routes, tables, "letters", scratch_path(spark, "ck"))
    return tables["good"].to_df().agg(F.lit("good").alias("kind"), F.count("*").alias("n")).union(tables["dead"].to_df().agg(F.lit("dead"), F.count("*")))


@add("SELECT event_id, user_id FROM events")
def stream_table_source(spark, sf):
    """A versioned table as a streaming source of its own format."""
    source.register(spark)
    t = VersionedTable.create(spark, scratch_path(spark, "source"), "event_id long, user_id long")
    e = table(spark, sf, "events").select("event_id", "user_id")
    t.append(e.where("event_id % 2 = 0"))
    t.append(e.where("event_id % 2 = 1"))
    return sinks.collected(spark.readStream.format("sparklake").option("path", t.path.removeprefix("file://")).load())


@add("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def table_source_batch(spark, sf):
    source.register(spark)
    t = VersionedTable.from_df(table(spark, sf, "events").select("event_id", "event_type"), scratch_path(spark, "source"))
    t.rename_column("event_type", "kind")
    found = spark.read.format("sparklake").option("path", t.path.removeprefix("file://")).load()
    return found.groupBy(F.col("kind").alias("event_type")).agg(F.count("*").alias("n"))


@add("SELECT event_id, 'insert' AS kind FROM events UNION ALL SELECT event_id, 'delete' FROM events WHERE event_type = 'click'")
def stream_table_changes(spark, sf):
    """A table's changes handed on version by version; a second run has nothing to do."""
    t = VersionedTable.create(spark, scratch_path(spark, "source"), "event_id long, event_type string", properties={"changeFeed": "true"})
    out = VersionedTable.create(spark, scratch_path(spark, "changes"), "event_id long, kind string")
    stream = sinks.TableStream(t, out, "changes")

    def handle(changes, version):
        out.append(changes.select("event_id", F.col("_change_type").alias("kind")), txn=("changes", version))

    t.append(table(spark, sf, "events").select("event_id", "event_type"))
    stream.run(handle)
    t.delete("event_type = 'click'")
    stream.run(handle)
    stream.run(handle)
    return out.to_df()


@add(f"SELECT user_id::VARCHAR AS user_id, session::BIGINT AS session, session_start, session_end, event_count FROM {_SESSIONS}")
def stream_medallion_sessions(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), "event_type", F.lit("/").alias("url"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("event_time"))
    root = scratch_path(spark, "clicks")
    # every third event comes a run late, amid sessions that are gold already; clicks come twice
    third = F.col("event_id").cast("long") % 3 == 0
    landing = _landed(spark, e.where(~third))
    clickstream.run(spark, landing, root)
    e.where(third | (F.col("event_type") == "click")).coalesce(1).write.mode("append").json(landing)
    tables = clickstream.run(spark, landing, root)
    return _ntz(tables["gold"].to_df())


@add("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_update_counts(spark, sf):
    """Update mode sends changed counts only; the last of each kind is the count."""
    e = _events(spark, sf)
    stream = _stream(spark, e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")).groupBy("event_type").agg(F.count("*").alias("n"))
    return sinks.collected(stream, "update").groupBy("event_type").agg(F.max("n").alias("n"))


@add("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS version FROM events")
def stream_static_refresh(spark, sf):
    """A dimension that is read anew for each batch."""
    names = VersionedTable.from_df(spark.range(1).select(F.lit("old").alias("version")), scratch_path(spark, "names"))
    out = VersionedTable.create(spark, scratch_path(spark, "out"), "event_id long, version string")
    e = _events(spark, sf)

    def write(batch, batch_id):
        out.append(batch.select("event_id").crossJoin(F.broadcast(names.to_df())), txn=("refresh", batch_id))
        names.update({"version": "'new'"})

    sinks.each_batch(_stream(spark, e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")), write, scratch_path(spark, "ck"))
    return out.to_df()


@add("SELECT 10::BIGINT AS n, 0::BIGINT AS first_value, 9::BIGINT AS last_value, TRUE AS ordered")
def stream_rate(spark, sf):
    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 10).option("numPartitions", 1).load()
    path, ck = scratch_path(spark, "rate"), scratch_path(spark, "ck")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", ck).trigger(once=True).start()
    sinks.finish(query)
    found = spark.read.schema("timestamp timestamp, value long").parquet(path)
    return found.agg(F.count("*").alias("n"), F.min("value").alias("first_value"), F.max("value").alias("last_value"), (F.max_by("value", F.struct("timestamp", "value")) == F.max("value")).alias("ordered"))
