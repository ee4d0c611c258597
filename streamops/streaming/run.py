"""Starting, draining and pacing streaming queries."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from streamops.constants import EMIT_INTERVAL, MICRO_BATCH_INTERVAL, MICRO_BATCH_RECORDS

MICRO_BATCH_BYTES = 256 * 1024**3

BatchHandler = Callable[[DataFrame, int], None]


NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(writer: DataStreamWriter, timeout: int | None = None,
          no_data_batches: bool = True) -> StreamingQuery:
    """Read until caught up, then stop. Failures of the query are raised here.

    Batches without data close windows the last data has passed. State with a
    retention in processing time asks for such batches for ever, so a drain over
    ``anti_cache`` must switch them off.
    """
    if no_data_batches:
        return await_caught_up(writer.trigger(availableNow=True).start(), timeout)
    conf = SparkSession.active().conf
    before = conf.get(NO_DATA_BATCHES)
    conf.set(NO_DATA_BATCHES, "false")
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        conf.set(NO_DATA_BATCHES, before)
    return await_caught_up(query, timeout)


def await_caught_up(query: StreamingQuery, timeout: int | None = None) -> StreamingQuery:
    """Wait for a draining query, at most ``timeout`` seconds."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream has not caught up within {timeout}s")
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows the recent batches of a query dropped for coming behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"]
               for batch in query.recentProgress for op in batch["stateOperators"])


class LateRows(StreamingQueryListener):
    """Counts, over all batches of the queries it hears of, the rows that came behind
    the watermark: ``with LateRows(spark) as late: drain(...)``, then ``late.total``.

    Spark counts them where it drops them, after rows of one group in one task have
    been combined. ``watermarks`` has the last watermark of every query.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.total, self.watermarks = spark, 0, {}
        self._open: set[str] = set()
        self._ended = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self._ended:
            self._open.add(str(event.id))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.total += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        if "watermark" in progress.eventTime:
            self.watermarks[str(progress.id)] = progress.eventTime["watermark"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._ended:
            self._open.discard(str(event.id))
            self._ended.notify_all()

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *failure) -> None:
        # Events come in order and a little later than the query ends.
        with self._ended:
            self._ended.wait_for(lambda: not self._open, timeout=30)
        self.spark.streams.removeListener(self)


def file_sink(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
              partition_by: list[str] | None = None) -> DataStreamWriter:
    """Exactly-once file output: files and source position commit together."""
    writer = (
        df.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return writer.partitionBy(*partition_by) if partition_by else writer


def handler(df: DataFrame, fn: BatchHandler, checkpoint: str,
            mode: str = "append") -> DataStreamWriter:
    """A consumer with one method: ``fn(batch, batch_id)``. Raising replays the batch."""
    return (
        df.writeStream.outputMode(mode).foreachBatch(fn)
        .option("checkpointLocation", checkpoint)
    )


def fan_out(df: DataFrame, root: str, subscribers: list[str],
            timeout: int | None = None) -> dict[str, str]:
    """Every subscriber gets every record through its own query and checkpoint.

    The queries run side by side; returned are the subscribers' output folders.
    """
    paths = {name: f"{root}/out/{name}" for name in subscribers}
    started = [
        file_sink(df, path, f"{root}/checkpoint/{name}")
        .queryName(f"subscriber-{name}").trigger(availableNow=True).start()
        for name, path in paths.items()
    ]
    for query in started:
        await_caught_up(query, timeout)
    return paths


def micro_batch(size: int = MICRO_BATCH_BYTES, files: int | None = None) -> Mapping[str, str]:
    """Reader options that bound a micro-batch of a log kept in files.

    Bytes suit large logs, whose batches should fill the cluster; a number of
    files suits logs whose files are the unit of arrival.
    """
    if files is not None:
        return {"maxFilesPerTrigger": str(files)}
    return {"maxBytesPerTrigger": str(size)}


def record_batches(records: int = MICRO_BATCH_RECORDS,
                   records_per_file: int = MICRO_BATCH_RECORDS) -> Mapping[str, str]:
    """Reader options for batches of at most ``records`` records of a log whose files
    hold at most ``records_per_file``; see ``log.log_append``."""
    if records < records_per_file:
        raise ValueError("a file is read whole: it may hold no more than a batch")
    return micro_batch(files=records // records_per_file)


def micro_batch_records(records: int = MICRO_BATCH_RECORDS) -> Mapping[str, str]:
    """The same bound in records, for the Kafka source."""
    return {"maxOffsetsPerTrigger": str(records)}


def paced(writer: DataStreamWriter, interval: str = MICRO_BATCH_INTERVAL) -> DataStreamWriter:
    """Run a micro-batch every ``interval``, such as a relay's pause."""
    return writer.trigger(processingTime=interval)


def emit_every(writer: DataStreamWriter, interval: str = EMIT_INTERVAL) -> DataStreamWriter:
    return paced(writer, interval)
