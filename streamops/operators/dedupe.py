"""Idempotent processing against a ledger of handled ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_id(df: DataFrame, key: str, order: str, copies: str | None = None) -> DataFrame:
    """The first row of every id; copies collapse before the shuffle.

    Rows without an id are no copies of each other and are left out here; see
    ``without_id``.
    ``copies`` names a column to hold how many rows the id has.
    """
    df = df.filter(F.col(key).isNotNull())
    rest = [c for c in df.columns if c not in (key, order)]
    row = F.min_by(F.struct(order, *rest), F.col(order)).alias("_row")
    if copies is None:
        return df.groupBy(key).agg(row).select(key, "_row.*")
    return df.groupBy(key).agg(row, F.count("*").alias(copies)).select(key, "_row.*", copies)


def without_id(df: DataFrame, key: str) -> DataFrame:
    """Rows no ledger can know again: they belong to the dead letters."""
    return df.filter(F.col(key).isNull())


def anti_ledger(df: DataFrame, ledger: DataFrame, key: str,
                ledger_key: str = "transaction_id") -> DataFrame:
    """Rows whose id the ledger does not hold.

    The ledger outgrows any batch, so it is first cut to the ids at hand: as the
    right side of the semi-join a small batch is broadcast and the ledger only
    scanned, never shuffled. Copies of a hot id collapse before that.
    """
    ids = df.select(F.col(key).alias(ledger_key)).distinct()
    known = ledger.select(ledger_key).join(ids, ledger_key, "left_semi")
    return df.join(known.withColumnRenamed(ledger_key, key), key, "left_anti")


def idempotent_process(df: DataFrame, ledger: DataFrame, key: str, order: str) -> DataFrame:
    """Each id once, the first time it is seen, unless the ledger has it; rows
    without an id are left to ``without_id``."""
    return anti_ledger(first_per_id(df, key, order), ledger, key)
