"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamops.session import configure, new_folder

# Rows and bytes of one Arrow batch: bounds what a task's Python holds at once.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per session: their Python needs it,
    and they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_package_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "streamops_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._package_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators count on; called by every query and stage."""
    configure(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts the lineage
    and outlives any executor. What was shuffled to make them is then garbage;
    Spark deletes those files when the driver's JVM collects, so it is asked to."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def fold_of(doc_id, parts: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts
