"""Versioned tables: every operation, with the rows that it must leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklake.plans._registry import Registry, table
from sparklake.session import scratch_path
from sparklake.table import VersionedTable

QUERIES = Registry()
add = QUERIES.add

_C = "SELECT c_custkey AS id, c_mktsegment AS seg, round(c_acctbal, 2) AS bal, c_nationkey AS nation FROM customer"


def _customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.round("c_acctbal", 2).alias("bal"), F.col("c_nationkey").alias("nation"))


def _made(spark, sf, where="true", partition_by=(), **properties):
    return VersionedTable.from_df(_customers(spark, sf).where(where), scratch_path(spark, "table"), partition_by, properties)


@add(f"{_C} WHERE FALSE")
def table_create(spark, sf):
    return VersionedTable.create(spark, scratch_path(spark, "table"), "id long, seg string, bal double, nation int").to_df()


@add(f"SELECT * FROM ({_C}) WHERE id <= 700 UNION ALL SELECT * FROM ({_C}) WHERE id > 600")
def table_append(spark, sf):
    t = _made(spark, sf, "id <= 700")
    t.append(_customers(spark, sf).where("id > 600"))
    return t.to_df()


@add(f"SELECT * FROM ({_C}) WHERE id > 600")
def table_overwrite(spark, sf):
    t = _made(spark, sf, "id <= 700")
    t.overwrite(_customers(spark, sf).where("id > 600"))
    return t.to_df()


@add(f"SELECT id, seg, CASE WHEN seg = 'BUILDING' THEN 0.0::DOUBLE ELSE bal END AS bal, nation FROM ({_C})")
def table_replace_where(spark, sf):
    t = _made(spark, sf, partition_by=("seg",))
    new = _customers(spark, sf).where("seg = 'BUILDING'").withColumn("bal", F.lit(0.0))
    t.replace_where(new, "seg = 'BUILDING'")
    t.replace_where(new, "seg = 'BUILDING'")  # a retry changes nothing
    return t.to_df()


@add(f"SELECT * FROM ({_C}) WHERE seg <> 'BUILDING' OR id < 300")
def table_dynamic_overwrite(spark, sf):
    t = _made(spark, sf, partition_by=("seg",))
    t.overwrite_partitions(_customers(spark, sf).where("seg = 'BUILDING' AND id < 300"))
    return t.to_df()


@add(f"SELECT id, CASE WHEN id % 2 = 0 THEN 'NEW' ELSE seg END AS seg, bal, nation FROM ({_C})")
def merge_upsert(spark, sf):
    t = _made(spark, sf, "id <= 1000")
    source = _customers(spark, sf).where("id % 2 = 0 OR id > 1000").withColumn("seg", F.when(F.col("id") % 2 == 0, "NEW").otherwise(F.col("seg")))
    t.merge(source, "t.id = s.id").when_matched_update().when_not_matched_insert().execute()
    return t.to_df()


@add(
    f"""SELECT id, CASE WHEN id <= 800 AND id % 3 = 1 THEN 'CHANGED' WHEN id > 800 THEN 'ADDED' ELSE seg END AS seg, bal, nation
    FROM ({_C}) WHERE NOT (id <= 800 AND id % 3 = 0) AND NOT (id > 800 AND id % 3 = 0)"""
)
def merge_cdc(spark, sf):
    """Operations I, U and D by id modulo 3; ids above 800 aren't in the table yet."""
    t = _made(spark, sf, "id <= 800")
    op = F.element_at(F.array(F.lit("D"), F.lit("U"), F.lit("I")), (F.col("id") % 3 + 1).cast("int"))
    source = _customers(spark, sf).withColumn("op", op)
    merge = t.merge(source, "t.id = s.id").when_matched_delete("s.op = 'D'").when_matched_update({"seg": "'CHANGED'"}, "s.op = 'U'")
    merge.when_not_matched_insert({"id": "s.id", "seg": "'ADDED'", "bal": "s.bal", "nation": "s.nation"}, "s.op <> 'D'").execute()
    return t.to_df()


@add(f"SELECT id, CASE WHEN id > 1100 AND id % 2 = 0 THEN 'GONE' ELSE seg END AS seg, bal, nation FROM ({_C}) WHERE id <= 1100 OR id % 2 = 0")
def merge_full_sync(spark, sf):
    t = _made(spark, sf, "id > 500")
    merge = t.merge(_customers(spark, sf).where("id <= 1100"), "t.id = s.id").when_matched_update().when_not_matched_insert()
    merge.when_not_matched_by_source_delete("t.id % 2 = 1").when_not_matched_by_source_update({"seg": "'GONE'"}).execute()
    return t.to_df()


@add("SELECT count(*) AS n, 3::BIGINT AS versions FROM customer")
def table_txn_idempotent(spark, sf):
    t = _made(spark, sf, "id <= 700")
    for _ in range(3):
        t.append(_customers(spark, sf).where("id > 700"), txn=("loader", 1))
    return t.to_df().agg(F.count("*").alias("n"), F.lit(t.version + 1).cast("long").alias("versions"))


@add("SELECT 'extra column' AS kind, TRUE AS refused UNION ALL SELECT 'wrong type', TRUE UNION ALL SELECT 'check', TRUE UNION ALL SELECT 'not null', TRUE")
def table_enforcement(spark, sf):
    t = _made(spark, sf)
    t.add_constraint("positive", "id >= 0")
    t.set_nullable("id", False)
    good = _customers(spark, sf)
    tries = {"extra column": good.withColumn("x", F.lit(1)), "wrong type": good.withColumn("bal", F.lit("text")), "check": good.withColumn("id", -1 - F.col("id")), "not null": good.withColumn("id", F.lit(None).cast("long"))}

    def refused(df) -> bool:
        try:
            t.append(df)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(k, refused(df)) for k, df in tries.items()], "kind string, refused boolean")


@add(f"SELECT id, seg, bal, nation, CASE WHEN id > 700 THEN id * 2 END AS twice FROM ({_C})")
def table_merge_schema(spark, sf):
    t = _made(spark, sf, "id <= 700")
    t.append(_customers(spark, sf).where("id > 700").withColumn("twice", F.col("id") * 2), merge_schema=True)
    return t.to_df()


@add("SELECT r_regionkey AS id, r_name AS name FROM region")
def table_overwrite_schema(spark, sf):
    t = _made(spark, sf)
    t.overwrite(table(spark, sf, "region").selectExpr("r_regionkey AS id", "r_name AS name"), overwrite_schema=True)
    return t.to_df()


@add(f"SELECT id, NULL::VARCHAR AS note, seg AS segment, bal FROM ({_C})")
def table_alter(spark, sf):
    t = _made(spark, sf)
    t.add_column("note", "string", after="id")
    t.rename_column("seg", "segment")
    t.drop_column("nation")
    return t.to_df()


@add(f"SELECT id, nation::BIGINT AS nation FROM ({_C}) UNION ALL SELECT 0, 5000000000")
def table_widen(spark, sf):
    t = VersionedTable.from_df(_customers(spark, sf).select("id", "nation"), scratch_path(spark, "table"))
    t.widen_column("nation", "long")
    t.append(spark.range(1).select("id", F.lit(5000000000).alias("nation")))
    return t.to_df()


@add("SELECT 1::BIGINT AS version, count(*) FILTER (c_custkey <= 700) AS n FROM customer UNION ALL SELECT 2, count(*) FROM customer UNION ALL SELECT 3, count(*) FILTER (c_custkey % 2 = 0) FROM customer")
def table_time_travel(spark, sf):
    t = _made(spark, sf, "id <= 700")
    t.append(_customers(spark, sf).where("id > 700"))
    t.delete("id % 2 = 1")
    parts = [t.to_df(v).agg(F.lit(v).cast("long").alias("version"), F.count("*").alias("n")) for v in (1, 2, 3)]
    return parts[0].union(parts[1]).union(parts[2])


@add("SELECT * FROM (VALUES (3::BIGINT, 'DELETE'), (2, 'UPDATE'), (1, 'APPEND'), (0, 'CREATE')) t(version, operation)")
def table_history(spark, sf):
    t = _made(spark, sf)
    t.update({"seg": "'x'"}, "id = 1")
    t.delete("id = 2")
    return t.history().select("version", "operation")


@add(f"SELECT * FROM ({_C})")
def table_restore(spark, sf):
    t = _made(spark, sf)
    t.delete("id > 10")
    t.update({"bal": "bal * 2"})
    t.restore(1)
    return t.to_df()


_CDF = f"""WITH c AS ({_C}) SELECT id, seg, 'insert' AS kind, 1::BIGINT AS version FROM c UNION ALL SELECT id, seg, 'update_preimage', 2 FROM c WHERE nation <= 8
    UNION ALL SELECT id, 'x', 'update_postimage', 2 FROM c WHERE nation <= 8 UNION ALL SELECT id, CASE WHEN nation <= 8 THEN 'x' ELSE seg END, 'delete', {{}} FROM c WHERE nation >= 5 AND nation <= 12"""


@add(_CDF.format(3))
def table_cdf(spark, sf):
    t = _made(spark, sf, changeFeed="true")
    t.update({"seg": "'x'"}, "nation <= 8")
    t.delete("nation BETWEEN 5 AND 12")
    return t.changes(1).select("id", "seg", F.col("_change_type").alias("kind"), F.col("_commit_version").alias("version"))


@add(_CDF.format(4))
def table_cdf_renamed(spark, sf):
    """Changes from before a column got its name."""
    t = _made(spark, sf, changeFeed="true")
    t.update({"seg": "'x'"}, "nation <= 8")
    t.rename_column("seg", "segment")
    t.delete("nation BETWEEN 5 AND 12")
    return t.changes(1).select("id", F.col("segment").alias("seg"), F.col("_change_type").alias("kind"), F.col("_commit_version").alias("version"))


@add("SELECT c_custkey AS id, c_acctbal < 0 AS debt, CASE WHEN c_acctbal < 0 THEN 'NEW' ELSE c_mktsegment END AS seg FROM customer")
def table_overwrite_by_boolean(spark, sf):
    """Partitions of a type without minima and maxima."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("debt"), F.col("c_mktsegment").alias("seg"))
    t = VersionedTable.from_df(rows, scratch_path(spark, "table"), ("debt",))
    t.overwrite_partitions(rows.where("debt").withColumn("seg", F.lit("NEW")))
    return t.to_df()


@add(f"SELECT id, CASE WHEN nation = 3 THEN 'NEW' ELSE seg END AS seg, bal, nation, TRUE AS skipped FROM ({_C}) WHERE nation <> 4")
def table_pruned_changes(spark, sf):
    """MERGE, DELETE and UPDATE on a table in the order of a column read the files that its values are in, and no others."""
    t = VersionedTable.from_df(_customers(spark, sf).repartitionByRange(8, "nation", "id"), scratch_path(spark, "table"))
    base = t.snapshot()
    source = _customers(spark, sf).where("nation = 3")
    t.merge(source.withColumn("seg", F.lit("NEW")), "t.nation = s.nation AND t.id = s.id").when_matched_update().execute()
    metrics = t.log.info(t.version)["operationMetrics"]
    few = metrics["filesSkipped"] > metrics["filesRead"] >= 1
    t.delete("nation = 4 AND id > 0")
    t.update({"bal": "bal"}, "nation >= 24")
    left = len(base.files.keys() & t.snapshot().files.keys())
    return t.to_df().withColumn("skipped", F.lit(few and left >= len(base.files) // 2))


@add("SELECT count(*) AS n, TRUE AS forgotten, TRUE AS refused, 4::BIGINT AS version FROM customer")
def table_log_retention(spark, sf):
    """Commits before a checkpoint go once they are older than the retention; the table's state stays, and so do later commits."""
    t = _made(spark, sf, "false", changeFeed="true", logRetentionHours="0")
    for k in range(3):
        t.append(_customers(spark, sf).where(f"id % 3 = {k}"))
    gone = t.clean_log()
    try:
        t.to_df(1)
        refused = False
    except ValueError:
        refused = True
    t.update({"seg": "lower(seg)"}, "nation = 3")
    again = VersionedTable.for_path(spark, t.path)
    return again.to_df().agg(F.count("*").alias("n"), F.lit(gone == [0, 1, 2, 3] and len(again.log.versions()) == 2).alias("forgotten"), F.lit(refused).alias("refused"), F.lit(again.version - 1).cast("long").alias("version"))


@add("SELECT 'added' AS kind, c_custkey AS id FROM customer WHERE c_custkey > 700 UNION ALL SELECT 'removed', c_custkey FROM customer WHERE c_custkey < 5")
def table_version_diff(spark, sf):
    t = _made(spark, sf, "id <= 700")
    t.append(_customers(spark, sf).where("id > 700"))
    t.delete("id < 5")
    a, b = t.to_df(1).select("id"), t.to_df().select("id")
    return b.subtract(a).select(F.lit("added").alias("kind"), "id").union(a.subtract(b).select(F.lit("removed"), "id"))


@add("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS total, TRUE AS fewer FROM customer")
def table_optimize(spark, sf):
    t = _made(spark, sf, "false")
    for k in range(6):
        t.append(_customers(spark, sf).where(f"id % 6 = {k}"))
    before = len(t.snapshot().files)
    t.optimize()
    return t.to_df().agg(F.count("*").alias("n"), F.sum("id").alias("total"), F.lit(len(t.snapshot().files) < before).alias("fewer"))


@add("SELECT count(*) AS n, TRUE AS skips FROM customer WHERE c_custkey BETWEEN 100 AND 120 AND c_nationkey BETWEEN 3 AND 5")
def table_zorder(spark, sf):
    t = VersionedTable.from_df(_customers(spark, sf).repartition(16), scratch_path(spark, "table"))
    ranges = {"id": (100, 120), "nation": (3, 5)}
    before = len(t.candidate_files(t.snapshot(), ranges))
    size = t.detail()["sizeInBytes"]
    t.optimize(z_order_by=("id", "nation"), target_bytes=size // 16 + 1)
    after = len(t.candidate_files(t.snapshot(), ranges))
    return t.scan(ranges).agg(F.count("*").alias("n"), F.lit(after * 2 <= before).alias("skips"))


@add("SELECT TRUE AS refused, TRUE AS listed, TRUE AS gone, count(*) AS n FROM customer WHERE c_custkey > 10")
def table_vacuum(spark, sf):
    t = _made(spark, sf)
    t.delete("id <= 10")
    try:
        t.vacuum(0)
        refused = False
    except ValueError:
        refused = True
    listed = t.vacuum(0, dry_run=True, force=True)
    gone = t.vacuum(0, force=True)
    return t.to_df().agg(F.lit(refused).alias("refused"), F.lit(len(listed) > 0).alias("listed"), F.lit(listed == gone and not any(t.store.exists(p) for p in gone)).alias("gone"), F.count("*").alias("n"))


@add("SELECT count(*) AS n, TRUE AS pruned FROM customer WHERE c_custkey BETWEEN 200 AND 220")
def table_data_skipping(spark, sf):
    t = VersionedTable.from_df(_customers(spark, sf).repartitionByRange(8, "id"), scratch_path(spark, "table"))
    ranges = {"id": (200, 220)}
    few = len(t.candidate_files(t.snapshot(), ranges)) <= 2
    return t.scan(ranges).agg(F.count("*").alias("n"), F.lit(few).alias("pruned"))


@add(f"SELECT id, seg, bal, nation, 'deep' AS kind FROM ({_C}) UNION ALL SELECT id, seg, bal, nation, 'shallow' FROM ({_C}) WHERE id <> 1")
def table_clone(spark, sf):
    t = _made(spark, sf)
    deep, shallow = t.clone(scratch_path(spark, "deep")), t.clone(scratch_path(spark, "shallow"), deep=False)
    shallow.delete("id = 1")
    t.overwrite(_customers(spark, sf).where("false"))
    return deep.to_df().withColumn("kind", F.lit("deep")).union(shallow.to_df().withColumn("kind", F.lit("shallow")))


@add(f"SELECT id, CASE WHEN nation = 3 THEN lower(seg) ELSE seg END AS seg, CASE WHEN nation = 3 THEN bal + 1 ELSE bal END AS bal, nation FROM ({_C})")
def table_update(spark, sf):
    t = _made(spark, sf)
    t.update({"seg": "lower(seg)", "bal": "bal + 1"}, "nation = 3")
    return t.to_df()


@add(f"SELECT * FROM ({_C}) WHERE NOT (bal < 0 AND nation > 10)")
def table_delete(spark, sf):
    t = _made(spark, sf)
    t.delete("bal < 0 AND nation > 10")
    return t.to_df()


@add("SELECT count(*) AS n, TRUE AS conflict FROM customer")
def table_concurrency(spark, sf):
    """Two writers of one version: a blind append goes behind the other, a rewrite that lost its files is refused."""
    t = _made(spark, sf, "id <= 700")
    base = t.snapshot()
    adds = t.stage(base, _customers(spark, sf).where("id > 700"))
    t.update({"seg": "'x'"}, "id = 1")
    t.log.commit(base, adds, "APPEND", {}, blind=True)
    try:
        t.log.commit(base, t.removes(base.files), "DELETE", {})
        conflict = False
    except RuntimeError:
        conflict = True
    return t.to_df().agg(F.count("*").alias("n"), F.lit(conflict).alias("conflict"))


@add("SELECT 13::BIGINT AS version, count(*) AS n FROM customer")
def table_checkpoint(spark, sf):
    """Beyond ten commits, state is read from a checkpoint of the log."""
    t = _made(spark, sf, "false")
    for k in range(12):
        t.append(_customers(spark, sf).where(f"id % 12 = {k}"))
    again = VersionedTable.for_path(spark, t.path)
    return again.to_df().agg(F.lit(again.version).cast("long").alias("version"), F.count("*").alias("n"))


@add("SELECT count(*) AS n, TRUE AS fewer FROM customer")
def table_maintenance(spark, sf):
    t = _made(spark, sf, "false", clusterBy="id, nation")
    for k in range(3):
        t.append(_customers(spark, sf).where(f"id % 3 = {k}"))
    done = t.maintain()
    return t.to_df().agg(F.count("*").alias("n"), F.lit(done["filesAfter"] < done["filesBefore"]).alias("fewer"))
