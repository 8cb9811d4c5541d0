"""Sinks and triggers. Every query gets its own checkpoint; replays of a batch change nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparklake.session import scratch_path
from sparklake.table import VersionedTable


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_trigger: int | None = None, **options) -> DataFrame:
    """New files of a folder, each once; a schema is mandatory. Files are taken in order of modification time."""
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def start(stream: DataFrame, checkpoint: str, kind: str | None = None, mode: str = "append", every: str | None = None, once: bool = False, continuous: str | None = None, table: str | None = None, name: str | None = None, **options) -> StreamingQuery:
    """Start a query with a trigger: ``every`` (processing time), ``once``, ``continuous`` (interval of its checkpoints), else all that is available.

    The sink is a catalog ``table`` or a format (``parquet``, ``memory`` under ``name``, ``console``, ``noop``, ``kafka``, ...).
    """
    trigger = {"processingTime": every} if every else {"once": True} if once else {"continuous": continuous} if continuous else {"availableNow": True}
    writer = stream.writeStream.outputMode(mode).options(**options).option("checkpointLocation", checkpoint).trigger(**trigger)
    writer = writer.queryName(name) if name else writer
    if table:
        return writer.toTable(table)
    return writer.format(kind or "noop").start()


class RowWriter:
    """For ``writeStream.foreach``: one writer for each partition of each batch, which sends its rows together when it closes.

    ``send(rows, partition, epoch)`` may see a partition again after a failure, so it should replace what it sent for that (partition, epoch).
    """

    def __init__(self, send: Callable[[list, int, int], None], most: int = 10_000):
        self.send, self.most = send, most

    def open(self, partition: int, epoch: int) -> bool:
        self.partition, self.epoch, self.rows = partition, epoch, []
        return True

    def process(self, row) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.most:
            self.send(self.rows, self.partition, self.epoch)
            self.rows = []

    def close(self, error) -> None:
        if error is None and self.rows:
            self.send(self.rows, self.partition, self.epoch)


def each_row(stream: DataFrame, writer: RowWriter, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hand every row to the writer, where it is, and wait."""
    return finish(stream.writeStream.foreach(writer).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def finish(query: StreamingQuery, timeout: int = 600) -> StreamingQuery:
    """Wait for a query that ends by itself (availableNow); raises its failure, or TimeoutError."""
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not end in {timeout} s")
    return query


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run f on all that is available, batch by batch, and wait. f may see a batch again after a failure."""
    return finish(stream.writeStream.foreachBatch(f).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def to_table(stream: DataFrame, table: VersionedTable, app: str, checkpoint: str, mode: str = "append", merge_schema: bool = False) -> StreamingQuery:
    """Append (or, in complete mode, overwrite) exactly once: the commit records (app, batch), so a replay is a no-op."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            table.overwrite(batch, txn=(app, batch_id))
        else:
            table.append(batch, merge_schema, txn=(app, batch_id))

    return each_batch(stream, write, checkpoint, mode)


def to_files(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Spark's exactly-once file sink."""
    return finish(stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream emits over all that is available, as a batch DataFrame (for tests and small reports)."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, "emitted"), scratch_path(spark, "checkpoint")
    schema = stream.schema
    if mode == "append":
        to_files(stream, path, checkpoint)
        return spark.read.schema(schema).parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    each_batch(stream, write, checkpoint, mode)
    return spark.read.schema(schema).parquet(path)


def upsert(stream: DataFrame, table: VersionedTable, keys: list[str], order: list, checkpoint: str) -> StreamingQuery:
    """Merge each batch's latest row of each key; an older row than the table's doesn't overwrite it.

    The first of ``order`` is the column that tells newer from older.
    """
    from sparklake.operators.dedup import latest

    newest = order[0]

    def write(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import functions as F

        one = latest(batch, keys, F.desc(newest), *order[1:])
        on = " AND ".join(f"t.`{k}` = s.`{k}`" for k in keys)
        table.merge(one, on).when_matched_update(condition=f"s.`{newest}` >= t.`{newest}`").when_not_matched_insert().execute()

    return each_batch(stream, write, checkpoint)


def fan_out(stream: DataFrame, routes: dict[str, Callable[[DataFrame], DataFrame]], tables: dict[str, VersionedTable], app: str, checkpoint: str) -> StreamingQuery:
    """Several tables from one read of each batch, e.g. good rows and a dead letter; each is exactly once by its own mark."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, route in routes.items():
                tables[name].append(route(batch), txn=(f"{app}-{name}", batch_id))
        finally:
            batch.unpersist()

    return each_batch(stream, write, checkpoint)


class TableStream:
    """A versioned table as a stream of its changes: each version is handed over once, progress is a commit mark in the sink.

    ``handle`` gets the changed rows of the new versions (with _change_type and _commit_version) and the last version; it should write
    with ``txn=(app, version)``, whose mark in the sink is also where the next run starts.
    """

    def __init__(self, source: VersionedTable, sink: VersionedTable, app: str, start: int = 0):
        self.source, self.sink, self.app, self.start = source, sink, app, start

    def position(self) -> int:
        return self.sink.snapshot().txns.get(self.app, self.start - 1)

    def run(self, handle: Callable[[DataFrame, int], None]) -> int:
        done, latest = self.position(), self.source.version
        if latest > done:
            handle(self.source.changes(done + 1, latest), latest)
        return latest
