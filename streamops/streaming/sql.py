"""A small SQL surface: stream views, maintained tables, push and pull queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.functions.codec import decode_json
from streamops.streaming.run import drain, file_sink, handler
from streamops.streaming.sinks import MaterializedTable

_JSON_LOG = T.StructType([T.StructField("value", T.StringType())])


def create_stream_view(spark: SparkSession, name: str, path: str, schema: T.StructType,
                       **options: str) -> DataFrame:
    """Create or replace a stream over JSON records, with a schema put on at reading.

    ``path`` holds the records as text lines. Spark SQL can query the view by
    name, in any letter case, and every such query is a streaming one.
    """
    raw = spark.readStream.format("text").schema(_JSON_LOG).options(**options).load(path)
    stream = decode_json(raw, schema)
    stream.createOrReplaceTempView(name)
    return stream


def insert_into_stream(rows: DataFrame, path: str) -> None:
    """Append rows to the records behind a stream view."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def push_query(spark: SparkSession, sql: str, path: str, checkpoint: str):
    """A standing query from the earliest record, as a writer to be started or drained."""
    return file_sink(spark.sql(sql), path, checkpoint)


def create_table_as_select(spark: SparkSession, sql: str, key: str, path: str,
                           checkpoint: str):
    """A maintained aggregate: its table, and the writer that keeps it up to date."""
    table = MaterializedTable(path, key)
    return table, handler(spark.sql(sql), table.put, checkpoint, mode="update")


def pull_query(spark: SparkSession, table: MaterializedTable,
               where: str | None = None) -> DataFrame:
    """Point-in-time read of a maintained table."""
    rows = table.pull(spark)
    return rows if where is None else rows.filter(where)


def refresh(writer, timeout: int | None = None) -> None:
    """Bring a standing query or a maintained table up to date and stop it."""
    drain(writer, timeout)
