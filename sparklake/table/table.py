"""Versioned tables: snapshots, writes, schema changes, time travel, change feed and maintenance."""

from __future__ import annotations

import datetime as dt
import json
import re
import time
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklake.table.log import ConcurrentWriteError, Log, Snapshot, Store
from sparklake.table.pruning import predicate_ranges

__all__ = ["ConcurrentWriteError", "ConstraintError", "SchemaError", "VersionedTable"]

CHANGE_FEED = "changeFeed"
#: Columns with minima and maxima for each file, unless the property says otherwise.
STATS_COLUMNS = 16
_RANGED = (T.IntegralType, T.FloatType, T.DoubleType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
#: Types that may widen, each to any later one of its row.
_WIDER = (("byte", "short", "integer", "long"), ("float", "double"))


#: What a partition folder is called whose value is null (Spark's own name for it).
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


class SchemaError(ValueError):
    pass


class ConstraintError(ValueError):
    pass


def _field(name: str, kind: T.DataType, nullable: bool = True, physical: str | None = None, comment: str | None = None) -> dict:
    return {"name": name, "physical": physical or name, "type": json.loads(kind.json()), "nullable": nullable, "comment": comment}


def _type(field: dict) -> T.DataType:
    return T.StructType.fromJson({"type": "struct", "fields": [{"name": "x", "type": field["type"], "nullable": True, "metadata": {}}]})[0].dataType


def _partition_text(field: dict) -> Column:
    """A partition value as text that is the same for equal values, in any session."""
    kind, value = _type(field), F.col(f"`{field['physical']}`")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.FloatType | T.DoubleType):
        return (value + F.lit(0).cast(kind)).cast("string")  # -0.0 becomes 0.0
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    return value.cast("string")


def _partition_values(path: str) -> list[str | None]:
    """The values that a staged file's folders are named by."""
    found = sorted((int(k), v) for k, v in re.findall(r"/_p(\d+)=([^/]*)", path))
    return [None if v == _NULL_FOLDER else unquote(v)[1:] for _, v in found]


def _can_widen(old: T.DataType, new: T.DataType) -> bool:
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    a, b = old.typeName(), new.typeName()
    return any(a in row and b in row and row.index(a) <= row.index(b) for row in _WIDER)


class VersionedTable:
    """A table at a path. Every write is one commit; readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, path)
        self.log = Log(self.store)

    # -- creation and state

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str, partition_by: tuple[str, ...] = (), properties: dict[str, str] | None = None) -> VersionedTable:
        table = cls(spark, path)
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if table.log.latest() >= 0:
            raise FileExistsError(f"{path} is a table already")
        meta = {"id": uuid.uuid4().hex, "fields": [_field(f.name, f.dataType, f.nullable) for f in schema], "partitionBy": list(partition_by), "properties": properties or {}, "constraints": {}}
        table.log.commit(Snapshot(), [{"protocol": {"reader": 1, "writer": 1}}, {"metaData": meta}], "CREATE", {})
        return table

    @classmethod
    def for_path(cls, spark: SparkSession, path: str) -> VersionedTable:
        table = cls(spark, path)
        table.snapshot()
        return table

    @classmethod
    def from_df(cls, df: DataFrame, path: str, partition_by: tuple[str, ...] = (), properties: dict[str, str] | None = None) -> VersionedTable:
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        table = cls.create(df.sparkSession, path, nullable, partition_by, properties)
        table.append(df)
        return table

    def snapshot(self, version: int | None = None, timestamp: str | dt.datetime | None = None) -> Snapshot:
        return self.log.snapshot(self.version_at(timestamp) if timestamp is not None else version)

    def version_at(self, timestamp: str | dt.datetime) -> int:
        """The latest version committed at or before the time (UTC if it names no zone)."""
        at = dt.datetime.fromisoformat(timestamp) if isinstance(timestamp, str) else timestamp
        ms = (at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)).timestamp() * 1000
        found = [v for v in self.log.versions() if self.log.info(v)["timestamp"] <= ms]
        if not found:
            raise ValueError(f"{self.path} has no version at {timestamp}")
        return max(found)

    @property
    def version(self) -> int:
        return self.log.latest()

    @staticmethod
    def schema_of(snapshot: Snapshot, physical: bool = False) -> T.StructType:
        return T.StructType([T.StructField(f["physical" if physical else "name"], _type(f), True) for f in snapshot.meta["fields"]])

    # -- reading

    def _load(self, snapshot: Snapshot, paths: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
        physical = self.schema_of(snapshot, physical=True)
        if not paths:
            empty = self.spark.createDataFrame([], self.schema_of(snapshot))
            for name in extra:
                empty = empty.withColumn(name, F.lit(None).cast("long" if name == "_row" else "string"))
            return empty
        df = self.spark.read.schema(physical).parquet(*[self.store.full(p) for p in paths])
        columns = [F.col(f"`{f['physical']}`").alias(f["name"]) for f in snapshot.meta["fields"]]
        places = {"_file": F.col("_metadata.file_path").alias("_file"), "_row": F.col("_metadata.row_index").alias("_row")}
        return df.select(*columns, *[places[x] for x in extra])

    def to_df(self, version: int | None = None, timestamp: str | dt.datetime | None = None) -> DataFrame:
        snapshot = self.snapshot(version, timestamp)
        return self._load(snapshot, list(snapshot.files))

    def candidate_files(self, snapshot: Snapshot, ranges: dict[str, tuple]) -> list[str]:
        """Files whose minima and maxima allow a row with lo <= column <= hi for each of the ranges (None: open)."""
        names = {f["name"]: f["physical"] for f in snapshot.meta["fields"]}
        plain = lambda x: x if x is None or isinstance(x, int | float | str) else str(x)
        out = []
        for path, add in snapshot.files.items():
            low, high = add["stats"].get("min", {}), add["stats"].get("max", {})
            ok = True
            for name, (lo, hi) in ranges.items():
                a, b, lo, hi = low.get(names[name]), high.get(names[name]), plain(lo), plain(hi)
                if a is not None and b is not None:
                    ok &= (hi is None or a <= hi) and (lo is None or b >= lo)
                elif names[name] in add["stats"].get("nulls", {}) and add["stats"]["nulls"][names[name]] == add["stats"]["rows"]:
                    ok = False
            if ok:
                out.append(path)
        return out

    def scan(self, ranges: dict[str, tuple], version: int | None = None) -> DataFrame:
        """Rows within the ranges, from the files that may hold any."""
        snapshot = self.snapshot(version)
        df = self._load(snapshot, self.candidate_files(snapshot, ranges))
        for name, (lo, hi) in ranges.items():
            df = df if lo is None else df.where(F.col(name) >= F.lit(lo))
            df = df if hi is None else df.where(F.col(name) <= F.lit(hi))
        return df

    # -- writing

    def _physical(self, snapshot: Snapshot, df: DataFrame) -> DataFrame:
        """df checked against the schema, in its order, types and physical names; absent columns are null."""
        fields = {f["name"]: f for f in snapshot.meta["fields"]}
        extra = [c for c in df.columns if c not in fields]
        if extra:
            raise SchemaError(f"columns {extra} are not in the table; allow it with merge_schema")
        for c, kind in zip(df.columns, (f.dataType for f in df.schema), strict=True):
            want = _type(fields[c])
            if kind != want and not isinstance(kind, T.NullType) and not _can_widen(kind, want) and json.loads(kind.json()) != fields[c]["type"] and not (isinstance(want, T.DecimalType) and isinstance(kind, T.IntegralType)):
                raise SchemaError(f"column {c} is {kind.simpleString()}; the table has {want.simpleString()}")
        columns = [(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(_type(f)).alias(f["physical"]) for n, f in fields.items()]
        return df.select(*columns)

    def check(self, snapshot: Snapshot, df: DataFrame) -> None:
        """Raises ConstraintError if a row breaks NOT NULL or a CHECK (a null check passes), all in one pass."""
        tests = {f"NOT NULL {f['name']}": F.col(f"`{f['name']}`").isNull() for f in snapshot.meta["fields"] if not f["nullable"]}
        tests |= {name: ~F.coalesce(F.expr(sql), F.lit(True)) for name, sql in snapshot.meta["constraints"].items()}
        if tests:
            row = df.agg(*[F.count_if(t).alias(f"c{i}") for i, t in enumerate(tests.values())]).first()
            broken = {name: n for name, n in zip(tests, row, strict=True) if n}
            if broken:
                raise ConstraintError(f"rows that break a constraint: {broken}")

    def stage(self, snapshot: Snapshot, df: DataFrame, data_change: bool = True, checked: bool = True) -> list[dict]:
        """Write df's rows as data files that no version has yet; the add actions. Constraints are checked on the files."""
        folder = f"data/{uuid.uuid4().hex}"
        physical, fields = self._physical(snapshot, df), {f["name"]: f for f in snapshot.meta["fields"]}
        parts = [fields[c] for c in snapshot.meta["partitionBy"]]
        if parts:
            # the columns stay in the files, so a list of files reads without their folders
            # (as folders, empty strings and nulls would be one, so values get a prefix)
            held = physical.withColumns({f"_p{i}": F.concat(F.lit("v"), _partition_text(f)) for i, f in enumerate(parts)})
            keys = [f"_p{i}" for i in range(len(parts))]
            # rebalancing splits a hot partition over tasks and puts small ones together
            held.hint("rebalance", *keys).write.partitionBy(*keys).parquet(self.store.full(folder))
        else:
            physical.write.parquet(self.store.full(folder))
        files = [(p, size) for p, size, _ in self.store.list(folder, recursive=True) if p.endswith(".parquet")]
        if not files:
            return []
        stats = self._stats(snapshot, [p for p, _ in files])
        if unknown := stats.keys() - {self._relative(p) for p, _ in files}:
            raise RuntimeError(f"rows of files that were not staged: {sorted(unknown)[:3]}")
        now = int(time.time() * 1000)
        adds = [{"add": {"path": self._relative(p), "size": size, "modificationTime": now, "dataChange": data_change, "partitionValues": _partition_values(p[len(self.store.full(folder)) :] if p.startswith(self.store.full(folder)) else p), "stats": stats[self._relative(p)]}} for p, size in files if self._relative(p) in stats]
        if checked:
            self.check(snapshot, self._load(snapshot, [a["add"]["path"] for a in adds]))
        return adds

    def _relative(self, path: str) -> str:
        """A data file's name in the log: relative to the table, or a whole path for another table's file."""
        plain, root = (re.sub("^file:/+", "/", p) for p in (path, self.path))
        return plain[len(root) + 1 :] if plain.startswith(root + "/") else plain

    def _of_metadata(self, uri: str) -> str:
        """The same from Spark's file metadata, which percent-encodes."""
        return self._relative(unquote(uri))

    def _stats(self, snapshot: Snapshot, paths: list[str]) -> dict[str, dict]:
        """Rows, null counts, minima and maxima for each file, in one distributed pass."""
        limit = int(snapshot.meta["properties"].get("statsColumns", STATS_COLUMNS))
        ranged = [f["physical"] for f in snapshot.meta["fields"][:limit] if isinstance(_type(f), _RANGED)]
        df = self.spark.read.schema(self.schema_of(snapshot, physical=True)).parquet(*paths).groupBy(F.col("_metadata.file_path").alias("f"))
        rows = df.agg(F.count("*").alias("n"), *[g(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(ranged) for k, g in (("a", F.min), ("b", F.max), ("c", lambda x: F.count_if(x.isNull())))]).collect()
        plain = lambda x: x if x is None or isinstance(x, int | float | str) else float(x) if not isinstance(x, dt.date) else str(x)
        out = {}
        for r in rows:
            stats = {"rows": r.n, "min": {}, "max": {}, "nulls": {}}
            for i, c in enumerate(ranged):
                stats["nulls"][c] = r[f"c{i}"]
                if r[f"a{i}"] is not None and r[f"a{i}"] == r[f"a{i}"] and r[f"b{i}"] == r[f"b{i}"]:
                    stats["min"][c], stats["max"][c] = plain(r[f"a{i}"]), plain(r[f"b{i}"])
            out[self._of_metadata(r.f)] = stats
        return out

    @staticmethod
    def removes(paths, data_change: bool = True) -> list[dict]:
        now = int(time.time() * 1000)
        return [{"remove": {"path": p, "deletionTimestamp": now, "dataChange": data_change}} for p in paths]

    def _evolved(self, snapshot: Snapshot, df: DataFrame, merge: bool, replace: bool) -> tuple[Snapshot, list[dict]]:
        """The snapshot with df's new columns (merge) or df's schema (replace), and the metaData action for it."""
        meta = json.loads(json.dumps(snapshot.meta))
        if replace:
            meta["fields"] = [_field(f.name, f.dataType, True, f"{f.name}-{uuid.uuid4().hex[:8]}") for f in df.schema]
            meta["partitionBy"] = [c for c in meta["partitionBy"] if c in df.columns]
        elif merge:
            known = {f["name"]: f for f in meta["fields"]}
            for f in df.schema:
                if f.name not in known:
                    meta["fields"].append(_field(f.name, f.dataType, True, f"{f.name}-{uuid.uuid4().hex[:8]}"))
                elif f.dataType != _type(known[f.name]) and _can_widen(_type(known[f.name]), f.dataType):
                    known[f.name]["type"] = json.loads(f.dataType.json())
        if meta == snapshot.meta:
            return snapshot, []
        return Snapshot(snapshot.version, meta, dict(snapshot.files), dict(snapshot.removed), dict(snapshot.txns)), [{"metaData": meta}]

    def _done(self, snapshot: Snapshot, txn: tuple[str, int] | None) -> bool:
        return txn is not None and snapshot.txns.get(txn[0], -1) >= txn[1]

    @staticmethod
    def _txn(txn: tuple[str, int] | None) -> list[dict]:
        return [] if txn is None else [{"txn": {"appId": txn[0], "version": txn[1]}}]

    def append(self, df: DataFrame, merge_schema: bool = False, txn: tuple[str, int] | None = None) -> int:
        """Add rows. ``txn`` (application, number) makes a repeated write a no-op."""
        base = self.snapshot()
        if self._done(base, txn):
            return base.version
        snapshot, meta = self._evolved(base, df, merge_schema, False)
        adds = self.stage(snapshot, df)
        return self.log.commit(base, [*meta, *self._txn(txn), *adds], "APPEND", {}, {"rows": sum(a["add"]["stats"]["rows"] for a in adds)}, blind=not meta)

    def overwrite(self, df: DataFrame, overwrite_schema: bool = False, txn: tuple[str, int] | None = None) -> int:
        base = self.snapshot()
        if self._done(base, txn):
            return base.version
        snapshot, meta = self._evolved(base, df, False, overwrite_schema)
        adds = self.stage(snapshot, df)
        return self.log.commit(base, [*meta, *self._txn(txn), *self.removes(base.files), *adds], "OVERWRITE", {})

    def replace_where(self, df: DataFrame, predicate: str) -> int:
        """Replace the rows for which the predicate is true by df, all of whose rows must satisfy it."""
        base = self.snapshot()
        test = F.expr(predicate)
        adds = self.stage(base, df)
        staged = self._load(base, [a["add"]["path"] for a in adds])
        if not staged.where(~F.coalesce(test, F.lit(False))).isEmpty():
            raise ConstraintError(f"rows to write don't satisfy {predicate}")
        touched = self._touched(base, predicate)
        kept = self._load(base, touched).where(~F.coalesce(test, F.lit(False)))
        return self.log.commit(base, [*self.removes(touched), *self.stage(base, kept, checked=False), *adds], "REPLACE WHERE", {"predicate": predicate})

    def overwrite_partitions(self, df: DataFrame) -> int:
        """Replace the partitions that df has rows of, and no others. A partition's values are in the log, whatever their type."""
        base = self.snapshot()
        if not base.meta["partitionBy"]:
            raise SchemaError("the table has no partition columns")
        adds = self.stage(base, df)
        key = lambda path, add: tuple(add["partitionValues"] if "partitionValues" in add else _partition_values(path))
        mine = {key(a["add"]["path"], a["add"]) for a in adds}
        return self.log.commit(base, [*self.removes(p for p, a in base.files.items() if key(p, a) in mine), *adds], "OVERWRITE PARTITIONS", {})

    def _touched(self, snapshot: Snapshot, predicate: str) -> list[str]:
        """Files with a row for which the predicate is true, of those whose minima and maxima allow one; the list is of files, never of rows."""
        may = self.candidate_files(snapshot, predicate_ranges(self.spark, predicate, self.schema_of(snapshot)))
        found = self._load(snapshot, may, ("_file",)).where(F.expr(predicate)).select("_file").distinct().collect()
        return [self._of_metadata(r["_file"]) for r in found]

    def _changes_file(self, snapshot: Snapshot, df: DataFrame) -> list[dict]:
        """Write change rows (the table's columns and _change_type) if the change feed is on. Columns get their physical names, which stay when
        one is renamed."""
        if snapshot.meta["properties"].get(CHANGE_FEED) != "true":
            return []
        folder = f"_change_data/{uuid.uuid4().hex}"
        names = {f["name"]: f["physical"] for f in snapshot.meta["fields"]}
        df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns]).write.parquet(self.store.full(folder))
        return [{"cdc": {"path": folder, "physical": True}}]

    def delete(self, predicate: str) -> int:
        base = self.snapshot()
        test = F.coalesce(F.expr(predicate), F.lit(False))
        touched = self._touched(base, predicate)
        rows = self._load(base, touched)
        cdc = self._changes_file(base, rows.where(test).withColumn("_change_type", F.lit("delete"))) if touched else []
        return self.log.commit(base, [*self.removes(touched), *self.stage(base, rows.where(~test), checked=False), *cdc], "DELETE", {"predicate": predicate})

    def update(self, assignments: dict[str, str], predicate: str = "true") -> int:
        """SET column = SQL expression for rows where the predicate is true."""
        base = self.snapshot()
        test = F.coalesce(F.expr(predicate), F.lit(False))
        touched = self._touched(base, predicate)
        rows = self._load(base, touched)
        kinds = {f.name: f.dataType for f in self.schema_of(base)}
        new = [F.when(test, F.expr(assignments[c])).otherwise(F.col(f"`{c}`")).cast(kinds[c]).alias(c) if c in assignments else F.col(f"`{c}`") for c in rows.columns]
        cdc = []
        if touched:
            hit = rows.where(test)
            after = hit.select(*[F.expr(assignments[c]).cast(kinds[c]).alias(c) if c in assignments else F.col(f"`{c}`") for c in rows.columns])
            cdc = self._changes_file(base, hit.withColumn("_change_type", F.lit("update_preimage")).union(after.withColumn("_change_type", F.lit("update_postimage"))))
        return self.log.commit(base, [*self.removes(touched), *self.stage(base, rows.select(*new)), *cdc], "UPDATE", {"predicate": predicate, "set": assignments})

    def merge(self, source: DataFrame, condition: str, merge_schema: bool = False):
        """A MERGE builder; see ``Merge``."""
        from sparklake.table.merge import Merge

        return Merge(self, source, condition, merge_schema)

    # -- schema and properties

    def _alter(self, operation: str, change, **parameters) -> int:
        base = self.snapshot()
        meta = json.loads(json.dumps(base.meta))
        change(meta)
        return self.log.commit(base, [{"metaData": meta}], operation, {k: str(v) for k, v in parameters.items()})

    @staticmethod
    def _find(meta: dict, name: str) -> dict:
        for f in meta["fields"]:
            if f["name"] == name:
                return f
        raise SchemaError(f"no column {name}")

    def add_column(self, name: str, kind: str, after: str | None = None, comment: str | None = None) -> int:
        def change(meta):
            if any(f["name"] == name for f in meta["fields"]):
                raise SchemaError(f"column {name} exists")
            at = len(meta["fields"]) if after is None else meta["fields"].index(self._find(meta, after)) + 1
            meta["fields"].insert(at, _field(name, T._parse_datatype_string(kind), True, f"{name}-{uuid.uuid4().hex[:8]}", comment))

        return self._alter("ADD COLUMN", change, name=name)

    def drop_column(self, name: str) -> int:
        return self._alter("DROP COLUMN", lambda meta: meta["fields"].remove(self._find(meta, name)), name=name)

    def rename_column(self, old: str, new: str) -> int:
        def change(meta):
            if any(f["name"] == new for f in meta["fields"]):
                raise SchemaError(f"column {new} exists")
            self._find(meta, old)["name"] = new
            meta["partitionBy"] = [new if c == old else c for c in meta["partitionBy"]]

        return self._alter("RENAME COLUMN", change, old=old, new=new)

    def widen_column(self, name: str, kind: str) -> int:
        new = T._parse_datatype_string(kind)

        def change(meta):
            field = self._find(meta, name)
            if not _can_widen(_type(field), new):
                raise SchemaError(f"{_type(field).simpleString()} can't widen to {kind}")
            field["type"] = json.loads(new.json())

        return self._alter("CHANGE COLUMN", change, name=name, type=kind)

    def set_nullable(self, name: str, nullable: bool) -> int:
        if not nullable and not self.to_df().where(F.col(name).isNull()).isEmpty():
            raise ConstraintError(f"{name} has nulls")
        return self._alter("CHANGE COLUMN", lambda meta: self._find(meta, name).update(nullable=nullable), name=name, nullable=nullable)

    def add_constraint(self, name: str, predicate: str) -> int:
        if not self.to_df().where(~F.coalesce(F.expr(predicate), F.lit(True))).isEmpty():
            raise ConstraintError(f"existing rows break {predicate}")
        return self._alter("ADD CONSTRAINT", lambda meta: meta["constraints"].update({name: predicate}), name=name, predicate=predicate)

    def drop_constraint(self, name: str) -> int:
        return self._alter("DROP CONSTRAINT", lambda meta: meta["constraints"].pop(name), name=name)

    def set_properties(self, **properties: str) -> int:
        return self._alter("SET PROPERTIES", lambda meta: meta["properties"].update(properties), **properties)

    # -- history

    def history(self) -> DataFrame:
        """Commits, newest first: version, timestamp, operation, parameters, metrics."""
        rows = [self.log.info(v) for v in sorted(self.log.versions(), reverse=True)]
        made = [(r["version"], dt.datetime.fromtimestamp(r["timestamp"] / 1000, dt.timezone.utc), r["operation"], {k: str(v) for k, v in r["operationParameters"].items()}, {k: int(v) for k, v in r["operationMetrics"].items()}) for r in rows]
        return self.spark.createDataFrame(made, "version long, timestamp timestamp, operation string, parameters map<string,string>, metrics map<string,long>")

    def detail(self) -> dict:
        s = self.snapshot()
        return {"path": self.path, "version": s.version, "numFiles": len(s.files), "sizeInBytes": sum(f["size"] for f in s.files.values()), "rows": sum(f["stats"]["rows"] for f in s.files.values()), "partitionBy": s.meta["partitionBy"], "properties": s.meta["properties"], "constraints": s.meta["constraints"]}

    def restore(self, version: int | None = None, timestamp: str | None = None) -> int:
        """A new commit with the files and schema of an earlier version."""
        now, then = self.snapshot(), self.snapshot(version, timestamp)
        gone = [p for p in then.files if p not in now.files and not self.store.exists(p)]
        if gone:
            raise FileNotFoundError(f"{len(gone)} files of version {then.version} were vacuumed")
        back = [{"add": f | {"dataChange": True}} for p, f in then.files.items() if p not in now.files]
        meta = [] if now.meta == then.meta else [{"metaData": then.meta}]
        return self.log.commit(now, [*meta, *self.removes(p for p in now.files if p not in then.files), *back], "RESTORE", {"version": then.version})

    def clone(self, path: str, deep: bool = True, version: int | None = None) -> VersionedTable:
        """A new table with this one's rows: own files (deep), or references to this one's."""
        s = self.snapshot(version)
        other = VersionedTable(self.spark, path)
        if other.log.latest() >= 0:
            raise FileExistsError(f"{path} is a table already")
        meta = json.loads(json.dumps(s.meta)) | {"id": uuid.uuid4().hex}
        blank = Snapshot(-1, meta)
        adds = other.stage(blank, self._load(s, list(s.files)), checked=False) if deep else [{"add": f | {"path": re.sub("^file:/+", "/", self.store.full(p))}} for p, f in s.files.items()]
        other.log.commit(Snapshot(), [{"protocol": {"reader": 1, "writer": 1}}, {"metaData": meta}, *adds], "CLONE", {"source": self.path, "version": s.version})
        return other

    def changes(self, start: int, end: int | None = None) -> DataFrame:
        """Changed rows of versions start to end with _change_type (insert, delete, update_preimage, update_postimage) and _commit_version.

        Commits with recorded changes give those; others give their added files as inserts and removed ones as deletes.
        """
        end = self.version if end is None else end
        latest = self.snapshot(end)
        kinds = {f.name: f.dataType for f in self.schema_of(latest)}
        out = self.spark.createDataFrame([], self.schema_of(latest)).withColumns({"_change_type": F.lit(""), "_commit_version": F.lit(0).cast("long")})
        for v in range(start, end + 1):
            actions = self.log.actions(v)
            recorded = [a["cdc"] for a in actions if "cdc" in a]
            if recorded:
                parts = []
                for cdc in recorded:
                    part = self.spark.read.parquet(self.store.full(cdc["path"]))
                    stored = {f["name"]: f["physical"] if cdc.get("physical") else f["name"] for f in latest.meta["fields"]}
                    columns = [F.col(f"`{c}`").cast(kinds[name]).alias(name) for name, c in stored.items() if c in part.columns]
                    parts.append(part.select(*columns, "_change_type"))
            else:
                parts = []
                for kind, action in (("insert", "add"), ("delete", "remove")):
                    paths = [a[action]["path"] for a in actions if action in a and a[action]["dataChange"]]
                    if paths:
                        parts.append(self._load(latest, paths).withColumn("_change_type", F.lit(kind)))
            for part in parts:
                out = out.unionByName(part.withColumn("_commit_version", F.lit(v).cast("long")), allowMissingColumns=True)
        return out

    # -- maintenance

    def optimize(self, z_order_by: tuple[str, ...] = (), ranges: dict[str, tuple] | None = None, target_bytes: int = 128 << 20) -> int:
        """Rewrite files without changing rows: small ones together, or all candidates ordered along a Z-curve of the columns."""
        base = self.snapshot()
        chosen = self.candidate_files(base, ranges) if ranges else list(base.files)
        if not z_order_by:
            chosen = [p for p in chosen if base.files[p]["size"] < target_bytes // 2]
        if len(chosen) < 2 and not z_order_by:
            return base.version
        n = max(1, -(-sum(base.files[p]["size"] for p in chosen) // target_bytes))
        rows = self._load(base, chosen)
        if z_order_by:
            rows = rows.withColumn("_z", z_value(rows, z_order_by)).repartitionByRange(int(n), "_z").sortWithinPartitions("_z").drop("_z")
        else:
            rows = rows.coalesce(int(n))
        return self.log.commit(base, [*self.removes(chosen, False), *self.stage(base, rows, data_change=False, checked=False)], "OPTIMIZE", {"zOrderBy": ",".join(z_order_by)}, {"removedFiles": len(chosen)})

    def cluster(self) -> int:
        """OPTIMIZE along the columns of the property ``clusterBy``, if it is set; else compaction."""
        keys = self.snapshot().meta["properties"].get("clusterBy", "")
        return self.optimize(z_order_by=tuple(c.strip() for c in keys.split(",") if c.strip()))

    def maintain(self, retain_hours: float = 168) -> dict[str, int]:
        """The regular job: cluster or compact, then vacuum."""
        before = len(self.snapshot().files)
        self.cluster()
        return {"filesBefore": before, "filesAfter": len(self.snapshot().files), "vacuumed": len(self.vacuum(retain_hours))}

    def vacuum(self, retain_hours: float = 168, dry_run: bool = False, force: bool = False) -> list[str]:
        """Delete files of rows and of changes that no version needs that is younger than the horizon; the files (to be) deleted."""
        if retain_hours < 168 and not force:
            raise ValueError("less than 168 hours may delete files that readers or writers still use; pass force to do it")
        s, horizon = self.snapshot(), time.time() * 1000 - retain_hours * 3_600_000
        needed = set(s.files) | {p for p, at in s.removed.items() if at > horizon}
        files = self.store.list("data", recursive=True) + self.store.list("_change_data", recursive=True)
        stale = [p for p, _, changed in files if p.endswith(".parquet") and changed <= horizon and self._relative(p) not in needed]
        if not dry_run:
            for p in stale:
                self.store.delete(p)
        return [self._relative(p) for p in stale]

    def clean_log(self, retain_hours: float | None = None) -> list[int]:
        """Write a checkpoint and delete commits before it that are older than the retention (the property ``logRetentionHours``, 720 by
        default); the versions that can't be read any more."""
        s = self.snapshot()
        hours = float(s.meta["properties"].get("logRetentionHours", 720)) if retain_hours is None else retain_hours
        horizon = time.time() * 1000 - hours * 3_600_000
        old = [v for v in sorted(self.log.versions()) if v < s.version and self.log.info(v)["timestamp"] <= horizon]
        if old:
            self.log.checkpoint(s)
            self.log.forget(old, s.version)
        return old


def z_value(df: DataFrame, columns: tuple[str, ...], bits: int = 8) -> Column:
    """Each column's rank among 2**bits quantiles, bits interleaved; nulls rank lowest. Up to seven columns."""
    if not 1 <= len(columns) <= 7:
        raise ValueError("a Z-curve takes one to seven columns")
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    numeric = {c: F.col(c).cast("double") if not isinstance(df.schema[c].dataType, T.StringType | T.DateType | T.TimestampType | T.TimestampNTZType) else _order_key(df, c) for c in columns}
    bounds = df.agg(*[F.percentile_approx(x, steps, 1000).alias(c) for c, x in numeric.items()]).first()
    z = F.lit(0).cast("long")
    for k, (c, x) in enumerate(numeric.items()):
        cuts = sorted(set(bounds[c] or []))
        rank = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b, x=x: b < x)), F.lit(0)).cast("long") if cuts else F.lit(0).cast("long")
        for b in range(bits):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1)), b * len(columns) + k))
    return z


def _order_key(df: DataFrame, c: str) -> Column:
    """A number in the column's order: seconds of dates and times, the first six bytes of strings."""
    if isinstance(df.schema[c].dataType, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
