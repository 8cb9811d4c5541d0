"""What a streaming query says about itself: progress, state and failure; and which output modes its plan allows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparklake.session import scratch_path

#: State store providers by name.
STATE_STORES = {
    "memory": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def progress(query: StreamingQuery) -> dict:
    """Sums over the kept progress reports (the last 100 by default): batches, input rows, rows in state, late rows dropped; and the last watermark."""
    reports = [p for p in query.recentProgress if p["numInputRows"] or p["stateOperators"]]
    last = query.lastProgress
    state = last["stateOperators"] if last else []
    return {
        "batches": len({p["batchId"] for p in reports}),
        "input_rows": sum(p["numInputRows"] for p in reports),
        "state_rows": sum(s["numRowsTotal"] for s in state),
        "late_rows": sum(s["numRowsDroppedByWatermark"] for p in reports for s in p["stateOperators"]),
        "watermark": (last or {}).get("eventTime", {}).get("watermark"),
        "active": query.isActive,
        "message": query.status["message"],
    }


def failure(query: StreamingQuery, timeout: int = 600) -> str | None:
    """The message of a query's failure, or None if it ended well; waits for its end."""
    try:
        if not query.awaitTermination(timeout):
            return None
    except StreamingQueryException:
        pass
    found = query.exception()
    return None if found is None else str(found)


def allowed_modes(stream: DataFrame) -> list[str]:
    """Output modes in which Spark starts the stream; each is started and stopped at once."""
    found = []
    for mode in ("append", "update", "complete"):
        try:
            query = stream.writeStream.outputMode(mode).format("noop").option("checkpointLocation", scratch_path(stream.sparkSession, "modes")).start()
        except AnalysisException:
            continue
        query.stop()
        found.append(mode)
    return found


@contextmanager
def state_store(spark: SparkSession, name: str) -> Iterator[None]:
    """Queries started within keep their state in this store: ``memory``, or ``rocksdb`` for state that outgrows the heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORES[name])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
