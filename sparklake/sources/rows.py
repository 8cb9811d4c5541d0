"""Rows leave the executors one batch after the other: HTTP and JDBC sinks, and JDBC reads in partitions."""

from __future__ import annotations

import json
import re
import shutil
import urllib.request
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def each_batch_of_rows(df: DataFrame, send: Callable[[list[Row]], None], size: int = 500) -> None:
    """Call ``send`` on the executors with up to ``size`` rows at a time; a retried task sends its rows again."""

    def run(rows: Iterator[Row]) -> None:
        held = []
        for row in rows:
            held.append(row)
            if len(held) >= size:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(run)


def post_rows(df: DataFrame, url: str, size: int = 500, timeout: float = 30) -> None:
    """POST the rows as JSON lines. The id of a batch, a hash of its content, travels as a header, by which the receiver can tell a repeat."""

    def send(rows: list[Row]) -> None:
        import hashlib

        body = "".join(json.dumps(r.asDict(recursive=True), default=str) + "\n" for r in rows).encode()
        headers = {"Content-Type": "application/x-ndjson", "Idempotency-Key": hashlib.sha256(body).hexdigest()}
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
            answer.read()

    each_batch_of_rows(df, send, size)


def jdbc_options(url: str, table: str, partition_column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int | None = None, fetch_size: int = 10_000, batch_size: int = 10_000, isolation: str = "READ_UNCOMMITTED", **options: str) -> dict[str, str]:
    """Options of Spark's JDBC source and sink. Partitions need their column and bounds, all or none: without them one connection reads everything."""
    split = (partition_column, lower, upper, partitions)
    if any(x is not None for x in split) and any(x is None for x in split):
        raise ValueError("partition_column, lower, upper and partitions go together")
    if partitions is not None and (partitions < 1 or lower >= upper):
        raise ValueError("bounds must rise and partitions be positive")
    if isolation not in ("NONE", "READ_UNCOMMITTED", "READ_COMMITTED", "REPEATABLE_READ", "SERIALIZABLE"):
        raise ValueError(f"no isolation level: {isolation}")
    found = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), "batchsize": str(batch_size), "isolationLevel": isolation, **options}
    if partition_column:
        found |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return found


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", connections: int = 8, **options) -> None:
    """Rows go through at most ``connections`` connections."""
    df.coalesce(connections).write.format("jdbc").mode(mode).options(**jdbc_options(url, table, **options)).save()


#: The embedded database that comes with Spark.
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
_DERBY_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "CLOB"}


def embedded_database(df: DataFrame, folder: str, name: str, connections: int = 8) -> str:
    """The URL of a Derby database below ``folder`` (which all machines mount) that has the rows of df in the table ``name``.

    Only the process that writes an embedded database can reach it. With a local master that is this one, and the rows go through
    ``write_jdbc``. The executors of a cluster are other processes: they write the rows as delimited text, the driver's database imports
    the files one after the other, none of which it holds, and is closed and packed; each process reads the packed database by itself.
    Columns are whole numbers, doubles or texts; nulls stay nulls and empty texts empty.
    """
    folder = re.sub(r"^file:/*", "/", folder)
    if not folder.startswith("/"):
        raise ValueError(f"not a mounted folder: {folder}")
    spark, home = df.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        url = f"jdbc:derby:directory:{home}/db;create=true"
        write_jdbc(df, url, name, "overwrite", connections, isolation="NONE", driver=DERBY)
        return url
    kinds = [(c, _DERBY_TYPES[t]) for c, t in df.dtypes]
    # texts are quoted even if empty, so they differ from nulls
    fields = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if t == "CLOB" else F.col(c).cast("string") for c, t in kinds]
    df.select(F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]).alias("value")).write.text(f"file://{home}/rows")
    connect = spark._jvm.java.sql.DriverManager.getConnection
    connection = connect(f"jdbc:derby:directory:{home}/db;create=true")
    try:
        statement = connection.createStatement()
        statement.execute(f"CREATE TABLE {name} ({', '.join(f'"{c}" {t}' for c, t in kinds)})")
        for part in sorted(Path(home, "rows").glob("part-*")):
            if part.stat().st_size:
                statement.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name.upper()}', '{part}', ',', '\"', 'UTF-8', 0)")
    finally:
        connection.close()
        try:
            connect(f"jdbc:derby:directory:{home}/db;shutdown=true")
        except Exception as e:  # a database says by an error that it is closed
            if "08006" not in str(e.java_exception.getSQLState()):
                raise
    with zipfile.ZipFile(f"{home}/db.jar", "w") as packed:  # not compressed, so pages are reached without those before
        for file in sorted(Path(home, "db").rglob("*")):
            if file.is_file() and file.suffix != ".lck":
                packed.write(file, file.relative_to(home))
    for done in ("rows", "db"):
        shutil.rmtree(f"{home}/{done}")
    return f"jdbc:derby:jar:({home}/db.jar)db"


def kafka_options(servers: str, subscribe: str | None = None, pattern: str | None = None, assign: dict[str, list[int]] | None = None, starting: str | dict = "latest", ending: str | dict | None = None, per_trigger: int | None = None, fail_on_loss: bool = True, **options: str) -> dict[str, str]:
    """Options of a Kafka source (the connector is a Spark package): just one of topics, pattern and partitions; offsets are ``earliest``, ``latest`` or
    {topic: {partition: offset}}, where -2 is the earliest and -1 the latest."""
    chosen = {"subscribe": subscribe, "subscribePattern": pattern, "assign": None if assign is None else json.dumps(assign)}
    if sum(v is not None for v in chosen.values()) != 1:
        raise ValueError("just one of subscribe, pattern and assign")
    if ending == "earliest" or (ending is not None and per_trigger is not None):
        raise ValueError("ending offsets are for batches, and not earliest")
    text = lambda x: x if isinstance(x, str) else json.dumps({t: {str(p): o for p, o in parts.items()} for t, parts in x.items()})
    found = {"kafka.bootstrap.servers": servers, "startingOffsets": text(starting), "failOnDataLoss": str(fail_on_loss).lower(), **options}
    found |= {k: v for k, v in chosen.items() if v is not None}
    if ending is not None:
        found["endingOffsets"] = text(ending)
    if per_trigger is not None:
        found["maxOffsetsPerTrigger"] = str(per_trigger)
    return found
