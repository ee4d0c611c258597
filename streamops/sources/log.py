"""Keyed logs: directories of files with the column layout of Spark's Kafka source.

Everything else works on the DataFrames these functions return, so moving to
``format("kafka")`` (see ``kafka_scan``) changes nothing downstream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.functions.partitioning import partition_by_key
from streamops.schemas import LOG


def log_scan(spark: SparkSession, path: str, schema: T.StructType = LOG, fmt: str = "parquet",
             **options: str) -> DataFrame:
    """Stream a log from its earliest record; the reader's checkpoint keeps its place."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def log_replay(spark: SparkSession, path: str, schema: T.StructType = LOG,
               fmt: str = "parquet", **options: str) -> DataFrame:
    """Read a log in full as a batch, to rebuild state from its first record."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def log_scan_multi(spark: SparkSession, paths: list[str], schema: T.StructType = LOG,
                   streaming: bool = True, **options: str) -> DataFrame:
    """One reader over several logs."""
    read = log_scan if streaming else log_replay
    return union_topics(*[read(spark, p, schema, **options) for p in paths])


def union_topics(*logs: DataFrame) -> DataFrame:
    first, *others = logs
    for other in others:
        first = first.unionByName(other)
    return first


def kafka_scan(spark: SparkSession, servers: str, topics: list[str], streaming: bool = True,
               **options: str) -> DataFrame:
    """The same columns from a broker; needs Spark's Kafka connector on the classpath."""
    reader = spark.readStream if streaming else spark.read
    raw = (
        reader.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
        .option("includeHeaders", "true").options(**options).load()
    )
    return raw.select("topic", "partition", "offset", "timestamp",
                      F.col("key").cast("string").alias("key"),
                      F.col("value").cast("string").alias("value"), "headers")


def to_log(df: DataFrame, topic: str | Column, key: Column, value: Column, offset: Column,
           timestamp: Column, partitions: int = 1, headers: Column | None = None,
           partition: Column | None = None) -> DataFrame:
    """Shape rows as log records. ``offset`` must come from the data, in order."""
    empty = F.array().cast(LOG["headers"].dataType)
    return df.select(
        (F.lit(topic) if isinstance(topic, str) else topic).alias("topic"),
        (partition_by_key(key, partitions) if partition is None else partition)
        .alias("partition"),
        offset.cast("long").alias("offset"),
        timestamp.cast("timestamp").alias("timestamp"),
        key.cast("string").alias("key"),
        value.alias("value"),
        (empty if headers is None else headers).alias("headers"),
    )


def json_value(*columns: str) -> Column:
    """The named columns as one JSON object, nulls left out."""
    return F.to_json(F.struct(*columns))


def log_append(df: DataFrame, path: str, fmt: str = "parquet",
               records_per_file: int | None = None) -> None:
    """Append a batch to a log. ``records_per_file`` bounds its files, and so what
    ``run.record_batches`` lets into one micro-batch."""
    writer = df.write.format(fmt).mode("append")
    if records_per_file is not None:
        writer = writer.option("maxRecordsPerFile", records_per_file)
    writer.save(path)


def route_by_column(df: DataFrame, path: str, column: str = "topic", mode: str = "append",
                    rebalance: bool = False) -> None:
    """Append each row to the topic it names: one directory per topic.

    Every task writes a file per topic it meets. With many topics, ``rebalance``
    gathers them first; Spark then splits the big ones and merges the small.
    """
    rows = df.hint("rebalance", column) if rebalance else df
    rows.write.mode(mode).partitionBy(column).parquet(path)


def read_topic(spark: SparkSession, path: str, topic: str, column: str = "topic") -> DataFrame:
    """One topic of a routed log; only its directory is read."""
    return spark.read.parquet(path).filter(F.col(column) == topic)


def read_committed(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Only what finished micro-batches have written: Spark follows the sink's own log."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
