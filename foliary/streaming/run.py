"""Running streams: until everything available is processed, or on a trigger."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which processors with state of their own need."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def run_batches(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], output_mode: str = "append", trigger: dict | None = None):
    """Run a stream through ``on_batch`` until everything available is processed, or on the given trigger."""
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    query = writer.foreachBatch(on_batch).trigger(**(trigger or {"availableNow": True})).start()
    if trigger is None:
        query.awaitTermination()
    return query


def run_to_files(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream to Parquet files."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    with state_on_disk(stream.sparkSession):
        query = writer.trigger(**(trigger or {"availableNow": True})).start()
    if trigger is None:
        query.awaitTermination()
    return query


def late_rows(query) -> int:
    """Rows that the stateful operators of a query dropped because they came after the watermark, over the batches in
    its recent progress (``spark.sql.streaming.numRecentProgressUpdates``)."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])
