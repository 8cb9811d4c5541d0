"""Versioned tables beyond the oracles: limits, conflicts and odd values."""

import datetime as dt
import decimal
import threading
import time

import pytest
from pyspark.sql import functions as F

from sparklake.session import scratch_path
from sparklake.dimensions import scd
from sparklake.pipelines import clickstream
from sparklake.table import VersionedTable, pruning
from sparklake.table.merge import AmbiguousMatchError
from sparklake.table.table import ConcurrentWriteError, ConstraintError, SchemaError


@pytest.fixture
def path(spark):
    return scratch_path(spark, "t")


def users(spark, *rows):
    return spark.createDataFrame(list(rows), "user_id long, name string, updated_at long")


def ids(df):
    return sorted(r.user_id for r in df.collect())


def test_merge_three_batches(spark, path):
    """Upsert, then an update only if newer, then inserts, updates and deletes by operation."""
    t = VersionedTable.from_df(users(spark, (1, "ann", 1000), (2, "bob", 1000), (3, "cat", 1000)), path)
    t.merge(users(spark, (2, "bob2", 1500), (4, "dan", 1500)), "t.user_id = s.user_id").when_matched_update().when_not_matched_insert().execute()
    assert ids(t.to_df()) == [1, 2, 3, 4]
    newer = t.merge(users(spark, (1, "stale", 500), (3, "cat3", 2000), (5, "eve", 2000)), "t.user_id = s.user_id")
    newer.when_matched_update(condition="s.updated_at > t.updated_at").when_not_matched_insert().execute()
    got = {r.user_id: r.name for r in t.to_df().collect()}
    assert got == {1: "ann", 2: "bob2", 3: "cat3", 4: "dan", 5: "eve"}
    ops = users(spark, (2, "x", 0), (6, "fay", 1), (4, "dan!", 9)).withColumn("op", F.element_at(F.create_map(F.lit(2), F.lit("D"), F.lit(6), F.lit("I"), F.lit(4), F.lit("U")), F.col("user_id").cast("int")))
    values = {c: f"s.{c}" for c in ("user_id", "name", "updated_at")}
    t.merge(ops, "t.user_id = s.user_id").when_matched_delete("s.op = 'D'").when_matched_update(values).when_not_matched_insert(values).execute()
    assert ids(t.to_df()) == [1, 3, 4, 5, 6]
    assert {k: v for k, v in t.history().first().metrics.items() if k.startswith("rows")} == {"rowsInserted": 1, "rowsUpdated": 1, "rowsDeleted": 1}


def test_merge_refuses_ambiguity_but_allows_idle_matches(spark, path):
    t = VersionedTable.from_df(users(spark, (1, "a", 1), (2, "b", 1)), path)
    twice = users(spark, (1, "x", 5), (1, "y", 6), (3, "new", 1))
    with pytest.raises(AmbiguousMatchError):
        t.merge(twice, "t.user_id = s.user_id").when_matched_update().execute()
    t.merge(twice, "t.user_id = s.user_id").when_matched_update(condition="s.updated_at > 5").when_not_matched_insert().execute()
    assert sorted((r.user_id, r.name) for r in t.to_df().collect()) == [(1, "y"), (2, "b"), (3, "new")]


def test_merge_null_keys_insert_and_replay_is_quiet(spark, path):
    t = VersionedTable.from_df(users(spark, (None, "null", 1), (2, "b", 1)), path)
    t.merge(users(spark, (None, "other", 1)), "t.user_id = s.user_id").when_matched_update().when_not_matched_insert().execute()
    assert t.to_df().count() == 3
    before = t.version
    t.merge(users(spark, (2, "b", 1)), "t.user_id = s.user_id").when_matched_update(condition="s.name <> t.name").execute()
    assert t.version == before


def test_merge_with_schema_evolution_and_change_feed(spark, path):
    t = VersionedTable.from_df(users(spark, (1, "a", 1)), path, properties={"changeFeed": "true"})
    source = users(spark, (1, "b", 2), (2, "c", 2)).withColumn("email", F.lit("x@y"))
    t.merge(source, "t.user_id = s.user_id", merge_schema=True).when_matched_update().when_not_matched_insert().execute()
    assert sorted((r.user_id, r.email) for r in t.to_df().collect()) == [(1, "x@y"), (2, "x@y")]
    changes = {(r.user_id, r.name, r["_change_type"]) for r in t.changes(t.version).collect()}
    assert changes == {(1, "a", "update_preimage"), (1, "b", "update_postimage"), (2, "c", "insert")}


def test_odd_partition_values(spark, path):
    values = ["a b", "x/y:z%", "é", "", None, "q=1", "50%25"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, p string")
    t = VersionedTable.from_df(df, path, ("p",))
    assert sorted((r.id, r.p) for r in t.to_df().collect()) == sorted(enumerate(values))
    t.delete("id = 1")
    t.update({"id": "id + 10"}, "p = 'a b'")
    assert sorted(r.id for r in t.to_df().collect()) == [2, 3, 4, 5, 6, 10]
    t.overwrite_partitions(spark.createDataFrame([(99, None)], "id long, p string"))
    assert sorted(r.id for r in t.to_df().collect()) == [2, 3, 5, 6, 10, 99]


@pytest.mark.parametrize(
    ("kind", "values", "properties"),
    [
        ("boolean", [True, False], {}),
        ("binary", [b"\x00\xff/", b"v"], {}),
        ("double", [float("nan"), None], {}),
        ("double", [0.0, 1e-300], {}),
        ("bigint", [3, 30], {"statsColumns": "1"}),
        ("timestamp", [dt.datetime(2024, 3, 31, 1, 30), dt.datetime(2024, 10, 27, 0, 30)], {}),
        ("decimal(30,10)", [None, decimal.Decimal(5)], {}),
        ("string", ["", None], {"statsColumns": "0"}),
    ],
)
def test_overwrite_replaces_just_the_partitions_of_its_rows(spark, path, kind, values, properties):
    schema = f"id long, p {kind}"
    t = VersionedTable.from_df(spark.createDataFrame([(i, values[i % 2]) for i in range(10)], schema).repartition(3), path, ("p",), properties)
    # in another session's zone the values are the same
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        t.overwrite_partitions(t.to_df().where("id = 0").select((F.col("id") + 100).alias("id"), "p").union(t.to_df().where("id = 2")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(r.id for r in t.to_df().collect()) == [1, 2, 3, 5, 7, 9, 100]


def test_negative_zero_is_the_partition_of_zero(spark, path):
    t = VersionedTable.from_df(spark.createDataFrame([(1, 0.0), (2, 1.0)], "id long, p double"), path, ("p",))
    t.overwrite_partitions(spark.createDataFrame([(3, -0.0)], "id long, p double"))
    assert sorted(r.id for r in t.to_df().collect()) == [2, 3]


def test_ranges_of_predicates(spark):
    schema = spark.createDataFrame([], "a int, b string, d double, t timestamp").schema
    ranges = lambda sql: pruning.predicate_ranges(spark, sql, schema)
    assert ranges("a >= 3 AND 7 > a AND b = 'x'") == {"a": (3, 7), "b": ("x", "x")}
    assert ranges("a = -5") == {"a": (-5, -5)}
    assert ranges("a = 1 OR b = 'x'") == ranges("NOT a = 1") == ranges("a + 1 = 2") == ranges("d > 1") == ranges("b > 3") == ranges("a = '3'") == ranges("true") == {}
    assert ranges("a > 5 AND (b = 'x' OR a < 9) AND a > 2") == {"a": (5, None)}
    target = spark.createDataFrame([], "k long, s string, x int").schema
    assert pruning.equal_columns(spark, "t.k = s.k AND s.s = t.s AND t.x = s.k AND t.k > 3", target, target) == [("k", "k"), ("s", "s")]
    assert pruning.equal_columns(spark, "t.k = s.k OR t.s = s.s", target, target) == []


@pytest.mark.parametrize("most", [10_000, 3])
def test_merge_reads_just_the_files_of_its_keys(spark, path, most, monkeypatch):
    monkeypatch.setattr(pruning, "KEYS", most)
    t = VersionedTable.from_df(users(spark, *[(i, f"n{i:03d}", 0) for i in range(100)]).repartitionByRange(10, "user_id"), path)
    t.append(users(spark, (None, None, 1)))
    source = users(spark, (5, "a", 1), (6, "b", 1), (8, "c", 1), (9, "d", 1), (500, "new", 1), (None, "null", 1))
    t.merge(source if most > 3 else source.where("user_id < 500 OR user_id IS NULL"), "t.user_id = s.user_id").when_matched_update().when_not_matched_insert().execute()
    metrics = t.history().first().metrics
    assert metrics["rowsUpdated"] == 4 and metrics["filesRead"] <= 2 and metrics["filesSkipped"] >= 9
    assert t.to_df().where("updated_at = 1").count() == (7 if most > 3 else 6)
    before = t.snapshot().files
    t.delete("user_id = 50 AND name >= 'n'")
    assert len(before.keys() - t.snapshot().files.keys()) == 1 and t.to_df().where("user_id = 50").isEmpty()
    # nothing changes, nothing is written
    files = len(t.store.list("data", recursive=True))
    t.merge(users(spark, (7, "x", 0)), "t.user_id = s.user_id").when_matched_update(condition="false").execute()
    assert len(t.store.list("data", recursive=True)) == files


def test_log_and_change_data_are_cleaned(spark, path):
    t = VersionedTable.from_df(users(spark, *[(i, "n", i) for i in range(20)]), path, properties={"changeFeed": "true"})
    t.update({"name": "'m'"}, "user_id < 5")
    t.delete("user_id = 7")
    want = sorted(map(str, t.to_df().collect()))
    assert t.clean_log() == []  # 30 days by default
    assert t.clean_log(0) == [0, 1, 2]
    assert any(p.startswith("_change_data") for p in t.vacuum(0, force=True))
    again = VersionedTable.for_path(spark, path)
    assert sorted(map(str, again.to_df().collect())) == want and again.version == 3
    for k in range(9):
        again.append(users(spark, (100 + k, "x", 0)))
    assert again.to_df().count() == 28 and len(again.to_df(5).collect()) == 21
    with pytest.raises(ValueError, match="not between"):
        again.to_df(2)


def test_late_changes_split_intervals(spark, path):
    import random

    r = random.Random(6)
    states = [(r.randrange(6), day, f"s{day}") for day in r.sample(range(100), 60)]
    t = scd.history_table(spark, path, "k", spark.createDataFrame(states, "k long, day int, seg string"), ["seg"], "day")
    for at in range(0, 60, 15):
        scd.apply_type2(t, spark.createDataFrame(states[at : at + 15], "k long, day int, seg string"), "k", "day", ["seg"])
    got = {}
    for x in t.to_df().collect():
        got.setdefault(x.k, []).append((x.valid_from, x.valid_to, x.seg, x.is_current))
    for k in {s[0] for s in states}:
        rows = sorted(got[k])
        # no gaps or overlaps, one open interval, and every change holds at its time
        assert [x[1] for x in rows[:-1]] == [x[0] for x in rows[1:]] and rows[-1][1] is None and [x[3] for x in rows] == [False] * (len(rows) - 1) + [True]
        for _, day, seg in (s for s in states if s[0] == k):
            assert next(x[2] for x in reversed(rows) if x[0] <= day) == seg


def test_a_late_event_joins_sessions(spark, path):
    def land(*rows):
        spark.createDataFrame([(i, "u", "click", "/", f"2024-01-01T{at}") for i, at in rows], "event_id string, user_id string, event_type string, url string, event_time string").coalesce(1).write.mode("append").json(f"{path}/in")

    land(("a", "00:00:00"), ("b", "00:50:00"))
    gold = clickstream.run(spark, f"{path}/in", f"{path}/out")["gold"]
    assert sorted(x.event_count for x in gold.to_df().collect()) == [1, 1]
    land(("c", "00:25:00"))
    clickstream.run(spark, f"{path}/in", f"{path}/out")
    assert [(x.session, x.event_count) for x in gold.to_df().collect()] == [(1, 3)]
    clickstream.run(spark, f"{path}/in", f"{path}/out")
    assert gold.to_df().count() == 1


def test_replace_where_refuses_rows_outside(spark, path):
    t = VersionedTable.from_df(users(spark, (1, "a", 1), (2, "b", 2)), path)
    with pytest.raises(ConstraintError):
        t.replace_where(users(spark, (1, "a", 1), (9, "z", 3)), "updated_at = 1")
    t.replace_where(users(spark, (7, "n", 1)), "updated_at = 1")
    assert ids(t.to_df()) == [2, 7]


def test_dropped_column_does_not_come_back(spark, path):
    t = VersionedTable.from_df(users(spark, (1, "a", 1)), path)
    t.drop_column("name")
    t.add_column("name", "string")
    assert t.to_df().first().name is None
    t.rename_column("name", "label")
    with pytest.raises(SchemaError):
        t.rename_column("label", "user_id")
    assert [r.name for r in t.to_df(1).collect()] == ["a"]


def test_widening_and_its_limits(spark, path):
    t = VersionedTable.from_df(spark.createDataFrame([(1, 1.5)], "a int, b float"), path)
    t.widen_column("a", "long")
    t.widen_column("b", "double")
    assert dict(t.to_df().dtypes) == {"a": "bigint", "b": "double"} and t.to_df().first() == (1, 1.5)
    with pytest.raises(SchemaError):
        t.widen_column("a", "int")


def test_time_travel_by_timestamp_and_restore_after_vacuum(spark, path):
    t = VersionedTable.from_df(users(spark, (1, "a", 1), (2, "b", 1)), path)
    time.sleep(0.05)
    at = dt.datetime.now(dt.timezone.utc)
    time.sleep(0.05)
    t.delete("user_id = 1")
    assert ids(t.to_df(timestamp=at)) == [1, 2]
    with pytest.raises(ValueError):
        t.to_df(timestamp="2001-01-01")
    with pytest.raises(ValueError):
        t.to_df(version=17)
    t.vacuum(0, force=True)
    with pytest.raises(FileNotFoundError):
        t.restore(1)


def test_concurrent_appends_all_land(spark, path):
    t = VersionedTable.create(spark, path, "user_id long, name string, updated_at long")
    failures = []

    def work(k):
        try:
            VersionedTable(spark, path).append(users(spark, (k, "x", k)))
        except Exception as e:  # shown by the assertion
            failures.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(6)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failures and ids(t.to_df()) == list(range(6)) and t.version == 6


def test_lost_race_is_refused(spark, path):
    t = VersionedTable.from_df(users(spark, (1, "a", 1), (2, "b", 1)), path)
    base = t.snapshot()
    t.append(users(spark, (3, "c", 1)))
    with pytest.raises(ConcurrentWriteError):
        t.log.commit(base, t.removes(base.files), "DELETE", {})
    base = t.snapshot()
    t.add_column("x", "int")
    with pytest.raises(ConcurrentWriteError):
        t.log.commit(base, [], "APPEND", {}, blind=True)


def test_empty_writes_and_tables(spark, path):
    t = VersionedTable.from_df(users(spark).limit(0), path)
    assert t.to_df().count() == 0 and t.detail()["rows"] == 0
    t.delete("user_id = 1")
    t.update({"name": "'x'"})
    t.merge(users(spark, (1, "a", 1)), "t.user_id = s.user_id").when_matched_update().when_not_matched_insert().execute()
    assert ids(t.to_df()) == [1]
    with pytest.raises(FileExistsError):
        VersionedTable.create(spark, path, "x int")
    with pytest.raises(FileNotFoundError):
        VersionedTable.for_path(spark, path + "-absent")
