"""Outbox relays: one pass takes the oldest pending rows and settles a prefix of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamops.constants import (
    DECODE_FAILED,
    MAX_PUBLISH_RETRIES,
    OUTBOX_COMPLETED,
    OUTBOX_FAILED,
    OUTBOX_PENDING,
    POISON,
)

PUBLISHED, FAILED, UNTOUCHED = "published", "failed", "untouched"


@dataclass(frozen=True)
class RelayPolicy:
    """How a relay selects rows and what it records about them."""

    name: str
    limit: int
    interval: str
    select_by_state: bool = False
    keeps_state: bool = False
    max_retries: int | None = None

    def pending(self) -> Column:
        if self.select_by_state:
            return F.col("state") == OUTBOX_PENDING
        return F.col("processed_on").isNull()


# Rows per pass and pause between passes of the three relays.
POLL = RelayPolicy("poll", 50, "500 milliseconds")
BATCH = RelayPolicy("batch", 20, "5 seconds", keeps_state=True)
STATE_MACHINE = RelayPolicy("state_machine", 100, "2 seconds", select_by_state=True,
                            keeps_state=True, max_retries=MAX_PUBLISH_RETRIES)


def outbox_scan(outbox: DataFrame, policy: RelayPolicy = POLL) -> DataFrame:
    """The oldest pending rows, at most ``policy.limit``, in one partition.

    Sort and limit plan as a top-n per task and a merge. The ``coalesce`` keeps
    it so: without it, columns added later are computed below the limit, which
    turns the top-n into a sort of the whole table.
    """
    return (
        outbox.filter(policy.pending()).orderBy("sequence").limit(policy.limit).coalesce(1)
    )


def prefix_until_failure(df: DataFrame, order: str, failed: Column,
                         partition_by: str | None = None) -> DataFrame:
    """Add ``first_failure``: the order value at which processing stops, or null.

    Any number of rows is allowed: the first failure is an aggregate, of all rows or
    of every entity by itself, that is handed back to the rows. ``failed`` is
    computed twice, so it must give the same both times.
    """
    if partition_by is None:
        first = df.filter(failed).agg(F.min(order)).scalar()
        return df.withColumn("first_failure", first)
    firsts = (
        df.filter(failed).groupBy(partition_by).agg(F.min(order).alias("first_failure"))
    )
    return df.join(firsts, partition_by, "left")


def _first_failure_of_batch(batch: DataFrame, failed: Column) -> DataFrame:
    """The same for the rows of one pass, ``policy.limit`` at most, which publishes each
    of them once."""
    failing = F.when(failed, F.col("sequence"))
    return batch.withColumn("first_failure", F.min(failing).over(Window.partitionBy()))


def retry_budget(retry_count: Column, max_retries: int = MAX_PUBLISH_RETRIES) -> Column:
    """State after one more failed publish."""
    return F.when(retry_count + 1 >= max_retries, OUTBOX_FAILED).otherwise(OUTBOX_PENDING)


def relay_pass(
    outbox: DataFrame,
    policy: RelayPolicy,
    now: Column,
    publish_error: Column,
    decoded: Column,
    partition_by: str | None = None,
) -> DataFrame:
    """The rows of one pass with their new columns and ``action``.

    ``decoded`` says whether the content could be read, ``publish_error`` is null
    where publishing works. Poison rows are stamped and stepped over; the first
    failed publish ends the pass and leaves the rows behind it untouched. All
    stamped rows get the same ``now``. ``partition_by`` relays the whole pending
    set instead of a bounded batch and ends the pass per entity.
    """
    batch = (outbox_scan(outbox, policy) if partition_by is None
             else outbox.filter(policy.pending()))
    batch = tried(batch, decoded, publish_error)
    batch = (_first_failure_of_batch(batch, failing()) if partition_by is None
             else prefix_until_failure(batch, "sequence", failing(), partition_by))
    return settled_until(batch, policy, now).select(*outbox.columns, "action")


def tried(batch: DataFrame, decoded: Column, publish_error: Column) -> DataFrame:
    """Rows with what became of reading and publishing them."""
    return batch.withColumns({
        "_decoded": F.coalesce(decoded, F.lit(False)), "_publish_error": publish_error,
    })


def failing() -> Column:
    return F.col("_publish_error").isNotNull() & F.col("_decoded")


def settled_until(batch: DataFrame, policy: RelayPolicy, now: Column) -> DataFrame:
    """Tried rows with ``action`` and new columns, settled up to their ``first_failure``."""
    stop, seq = F.col("first_failure"), F.col("sequence")
    action = (
        F.when(stop.isNotNull() & (seq > stop), UNTOUCHED)
        .when(seq == stop, FAILED)
        .when(F.col("_decoded"), PUBLISHED)
        .otherwise(POISON)
    )
    return _settle(batch.withColumn("action", action), policy, now)


def _settle(rows: DataFrame, policy: RelayPolicy, now: Column) -> DataFrame:
    action = F.col("action")
    given_up = F.lit(False)
    if policy.max_retries is not None:
        given_up = (action == FAILED) & (
            retry_budget(F.col("retry_count"), policy.max_retries) == OUTBOX_FAILED
        )
    stamped = action.isin(PUBLISHED, POISON) | given_up
    changes = {
        "processed_on": F.when(stamped, now).otherwise(F.col("processed_on")),
        "error": F.when(action == POISON, DECODE_FAILED).otherwise(F.col("error")),
    }
    if policy.keeps_state:
        changes["state"] = (
            F.when(action == PUBLISHED, OUTBOX_COMPLETED)
            .when((action == POISON) | given_up, OUTBOX_FAILED)
            .otherwise(F.col("state"))
        )
        changes["retry_count"] = F.when(
            action == FAILED, F.col("retry_count") + 1
        ).otherwise(F.col("retry_count"))
        changes["error"] = (
            F.when(action == POISON, DECODE_FAILED)
            .when(action == FAILED, F.col("_publish_error"))
            .when(action == UNTOUCHED, F.col("error"))
        )
    return rows.withColumns(changes)


def agg_relay_report(rows: DataFrame) -> DataFrame:
    """Published and taken rows of one pass."""
    return rows.agg(
        F.count_if(F.col("action") == PUBLISHED).alias("published"),
        F.count("*").alias("total"),
    )


def apply_pass(outbox: DataFrame, rows: DataFrame) -> DataFrame:
    """The outbox after a pass: each settled row replaces the one with its id."""
    changed = [c for c in ("processed_on", "state", "retry_count", "error")]
    new = rows.filter(F.col("action") != UNTOUCHED).select(
        "id", F.struct(*changed).alias("_new")
    )
    joined = outbox.join(new, "id", "left")
    return joined.withColumns({
        c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c))
        for c in changed
    }).select(*outbox.columns)
