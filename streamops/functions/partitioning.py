"""Assignment of keys to log partitions, and audits of it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamops.constants import REGION_PARTITIONS


def partition_by_key(key: Column, partitions: int) -> Column:
    """CRC32 of the key's bytes modulo ``partitions``: one key, one partition."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(partitions)).cast("int")


def partition_by_region(
    key: Column,
    partitions: int,
    pinned: Mapping[str, int] = REGION_PARTITIONS,
    rest_hash: Column | None = None,
) -> Column:
    """Pinned keys keep their own partition, all others share the remaining ones.

    ``rest_hash`` replaces the stable hash used for keys that are not pinned. A
    null key counts as the empty text.
    """
    if partitions <= len(pinned):
        raise ValueError("there must be partitions left for keys that are not pinned")
    text = F.coalesce(key, F.lit(""))
    rest = F.xxhash64(text) if rest_hash is None else rest_hash
    others = F.lit(len(pinned)) + F.pmod(rest, F.lit(partitions - len(pinned)))
    assigned = others
    for name, number in pinned.items():
        assigned = F.when(text == name, F.lit(number)).otherwise(assigned)
    return assigned.cast("int")


def agg_partition_spread(df: DataFrame, partition: str, key: str) -> DataFrame:
    """Records per partition and key."""
    return df.groupBy(partition, key).agg(F.count("*").alias("records"))


def partition_invariant(df: DataFrame, partition: str, key: str) -> DataFrame:
    """Per key, the number of partitions it reached; more than one breaks ordering."""
    return df.groupBy(key).agg(
        F.count_distinct(partition).alias("partitions"),
        F.count("*").alias("records"),
    ).withColumn("single_partition", F.col("partitions") == 1)
