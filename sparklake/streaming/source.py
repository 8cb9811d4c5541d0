"""Versioned tables as a Python data source, ``format("sparklake")``: batch, and a stream of appended rows by version.

The reader plans on the driver from the log and reads Parquet files on the executors with Arrow, so the path must be one that
Arrow's file systems open on every node. ``TableStream`` has no such limit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructField, StructType


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Log:
    """The log's commit files by Arrow: data sources have no session."""

    def __init__(self, root: str):
        self.fs, self.root = _open(root.rstrip("/"))

    def versions(self) -> list[int]:
        infos = self.fs.get_file_info(fs.FileSelector(f"{self.root}/_log"))
        return sorted(int(i.base_name[:20]) for i in infos if i.base_name.endswith(".json"))

    def actions(self, version: int) -> list[dict]:
        with self.fs.open_input_stream(f"{self.root}/_log/{version:020d}.json") as f:
            return [json.loads(line) for line in f.readall().decode().splitlines()]

    def state(self) -> tuple[dict, dict]:
        """The latest metadata and files: from the last whole checkpoint, and the commits behind it."""
        meta, files, start = {}, {}, -1
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/_log", recursive=True))
        whole = [i.path for i in found if i.path.endswith(".checkpoint.parquet/_SUCCESS")]
        if whole:
            folder = max(whole).rsplit("/", 1)[0]
            start = int(folder.rsplit("/", 1)[1][:20])
            parts = [i.path for i in found if i.path.startswith(folder + "/") and i.path.endswith(".parquet")]
            for action in pq.read_table(parts, filesystem=self.fs).column("action").to_pylist():
                ((kind, body),) = json.loads(action).items()
                if kind == "metaData":
                    meta = body
                elif kind == "add":
                    files[body["path"]] = body
        for v in (v for v in self.versions() if v > start):
            for a in self.actions(v):
                ((kind, body),) = a.items()
                if kind == "metaData":
                    meta = body
                elif kind == "add":
                    files[body["path"]] = body
                elif kind == "remove":
                    files.pop(body["path"], None)
        return meta, files

    def full(self, path: str) -> str:
        return path if path.startswith("/") or "://" in path else f"{self.root}/{path}"


class _Reads:
    def __init__(self, root: str, schema: StructType, physical: dict[str, str]):
        self.root, self.schema, self.physical = root, schema, physical

    def read(self, part: FilePart) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        files, path = _open(part.path)
        want = to_arrow_schema(self.schema)
        with files.open_input_file(path) as f:
            held = pq.ParquetFile(f)
            columns = {f.name: self.physical[f.name] for f in want}
            have = set(held.schema_arrow.names)
            # a batch at a time, not the whole file
            for batch in held.iter_batches(columns=[c for c in columns.values() if c in have]):
                made = [batch.column(c).cast(want.field(n).type) if c in have else pa.nulls(len(batch), want.field(n).type) for n, c in columns.items()]
                yield pa.RecordBatch.from_arrays(made, schema=want)


class _Batch(_Reads, DataSourceReader):
    def partitions(self):
        log = _Log(self.root)
        _, files = log.state()
        return [FilePart(log.full(p)) for p in files]


class _Stream(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"version": -1}

    def latestOffset(self) -> dict:
        return {"version": _Log(self.root).versions()[-1]}

    def partitions(self, start: dict, end: dict):
        log = _Log(self.root)
        return [FilePart(log.full(a["add"]["path"])) for v in range(start["version"] + 1, end["version"] + 1) for a in log.actions(v) if "add" in a and a["add"]["dataChange"]]

    def commit(self, end: dict) -> None:
        pass


class TableSource(DataSource):
    """Option ``path``: the table. A stream gives rows of added files whose commit changed data (rewrites repeat rows, as with ``ignoreChanges``)."""

    @classmethod
    def name(cls) -> str:
        return "sparklake"

    def _meta(self) -> dict:
        return _Log(self.options["path"]).state()[0]

    def schema(self) -> StructType:
        fields = [{"name": f["name"], "type": f["type"], "nullable": True, "metadata": {}} for f in self._meta()["fields"]]
        return StructType([StructField.fromJson(f) for f in fields])

    def _reads(self, kind, schema: StructType):
        return kind(self.options["path"], schema, {f["name"]: f["physical"] for f in self._meta()["fields"]})

    def reader(self, schema: StructType) -> DataSourceReader:
        return self._reads(_Batch, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return self._reads(_Stream, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TableSource)
