"""The clickstream pipeline: raw lines, deduplicated events and user sessions, each layer a stream with its own checkpoint."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparklake.operators.dedup import latest
from sparklake.operators.temporal import sessionize
from sparklake.streaming import sinks
from sparklake.table import VersionedTable

EVENT = "event_id string, user_id string, event_type string, url string, event_time timestamp"


def run(spark: SparkSession, landing: str, root: str, gap_seconds: int = 1800) -> dict[str, VersionedTable]:
    """Process all files that have come since the last run; sessions are rebuilt from new users' events only.

    Bronze keeps raw lines, silver one row for each event_id, gold the sessions of each user, all of which are replaced where new
    events come, however late. A replay of any layer changes nothing.
    """
    tables = {}
    for name, schema, part in (("bronze", "raw_value string, bronze_date date", ("bronze_date",)), ("silver", f"{EVENT}", ("event_type",)), ("gold", "user_id string, session long, session_start timestamp, session_end timestamp, event_count long", ())):
        tables[name] = VersionedTable(spark, f"{root}/{name}")
        if tables[name].version < 0:
            tables[name] = VersionedTable.create(spark, f"{root}/{name}", schema, part)
    raw = sinks.file_stream(spark, landing, "value string", "text").select(F.col("value").alias("raw_value"), F.current_date().alias("bronze_date"))
    sinks.to_table(raw, tables["bronze"], "bronze", f"{root}/checkpoints/bronze")

    def silver(changes, version):
        new = changes.where("_change_type = 'insert'").select(F.from_json("raw_value", EVENT).alias("p")).select("p.*").where("event_id IS NOT NULL AND event_time IS NOT NULL AND event_type IS NOT NULL")
        one = latest(new, ["event_id"], F.desc("event_time"), "user_id", "event_type", "url")
        unseen = one.join(tables["silver"].to_df().select("event_id"), "event_id", "left_anti")
        tables["silver"].append(unseen, txn=("silver", version))

    sinks.TableStream(tables["bronze"], tables["silver"], "silver").run(silver)

    def gold(changes, version):
        users = changes.where("_change_type = 'insert'").select("user_id").distinct()
        events = tables["silver"].to_df().join(users, "user_id", "left_semi")
        sessions = sessionize(events, "user_id", "event_time", gap_seconds, "event_id").groupBy("user_id", "session")
        new = sessions.agg(F.min("event_time").alias("session_start"), F.max("event_time").alias("session_end"), F.count("*").alias("event_count"))
        # a late event may join sessions: those of these users that are no more go
        gone = tables["gold"].to_df().join(users, "user_id", "left_semi").join(new.select("user_id", "session"), ["user_id", "session"], "left_anti")
        source = new.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)))
        values = {c: f"s.{c}" for c in new.columns}
        differs = "NOT (t.session_start <=> s.session_start AND t.session_end <=> s.session_end AND t.event_count <=> s.event_count)"
        merge = tables["gold"].merge(source, "t.user_id = s.user_id AND t.session = s.session").when_matched_delete("s.gone")
        merge.when_matched_update(values, differs).when_not_matched_insert(values).execute()
        tables["gold"].append(new.limit(0), txn=("gold", version))  # the mark; the merge itself can be repeated

    sinks.TableStream(tables["silver"], tables["gold"], "gold").run(gold)
    return tables
