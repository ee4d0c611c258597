"""Services that talk through topics: one streaming query each, with its own checkpoint.

A service reads the topics it subscribes to and writes what it emits to a folder
of its own, by topic. That folder is a file sink's, so a message is there for its
readers once the emitting batch has committed, and once only: a service that is
stopped anywhere goes on from its checkpoint. Services may read each other in
circles, as compensation needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.sources import log
from streamops.streaming.run import await_caught_up, file_sink

OUTSIDE = "outside"


@dataclass(frozen=True)
class Service:
    """``step`` turns messages of ``topics`` into messages with their ``topic``.
    ``after`` names the services that write to these topics; ``OUTSIDE`` is what
    ``Topology.publish`` brings in."""

    name: str
    topics: tuple[str, ...]
    after: tuple[str, ...]
    step: Callable[[DataFrame], DataFrame]


class Topology:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, services: list[Service]):
        self.spark, self.root, self.services = spark, root, services
        self.schema = T.StructType([*schema.fields, T.StructField("topic", T.StringType())])
        # A reader needs its folders: a write of no rows makes one without a file.
        none = spark.createDataFrame([], self.schema)
        for name in (OUTSIDE, *[s.name for s in services]):
            none.write.mode("append").partitionBy("topic").parquet(self._folder(name))

    def _folder(self, name: str) -> str:
        return f"{self.root}/topics/{name}"

    def publish(self, messages: DataFrame) -> None:
        """Messages from outside, each to the topic it names."""
        log.route_by_column(messages.select(*self.schema.fieldNames()), self._folder(OUTSIDE))

    def _source(self, service: Service, **options: str) -> DataFrame:
        logs = [log.log_scan(self.spark, self._folder(name), self.schema, **options)
                for name in service.after]
        return log.union_topics(*logs).filter(F.col("topic").isin(*service.topics))

    def writer(self, service: Service, **options: str):
        """The service as a stream writer, to be started with any trigger."""
        out = service.step(self._source(service, **options)).select(*self.schema.fieldNames())
        return file_sink(out, self._folder(service.name), f"{self.root}/checkpoints/{service.name}",
                         partition_by=["topic"])

    def drain(self, timeout: int | None = None, most: int | None = None) -> int:
        """Let every service catch up, in turn, until none has anything left to read;
        returns the number of passes. ``most`` guards against messages that circle
        for ever: beyond it an error is raised."""
        passes = 0
        while True:
            passes += 1
            read = 0
            for service in self.services:
                query = await_caught_up(self.writer(service).trigger(availableNow=True).start(), timeout)
                read += sum(p.numInputRows for p in query.recentProgress)
            if not read:
                return passes
            if most is not None and passes >= most:
                raise RuntimeError(f"messages still move after {most} passes")

    def messages(self, *topics: str) -> DataFrame:
        """What stands in the given topics, or in all: committed messages only."""
        logs = [log.read_committed(self.spark, self._folder(name), self.schema)
                for name in (OUTSIDE, *[s.name for s in self.services])]
        rows = log.union_topics(*logs)
        return rows.filter(F.col("topic").isin(*topics)) if topics else rows
