"""Folds by key, final and running.

Final folds are plain aggregates: they combine before the shuffle, so a hot key
costs one row per task. Running folds need order within a key. A key with more
rows than ``chunk`` is cut into chunks of about as many consecutive rows, and what
its earlier chunks sum up to is added; all other keys are folded as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamops.constants import (
    ACCOUNT_CREDIT,
    ACCOUNT_DEBIT,
    OP_CREATE,
    OP_DELETE,
    OP_UPDATE,
)

CHUNK = 1_000_000


def signed_amount(kind: Column, amount: Column) -> Column:
    """Deposits count up, withdrawals down, anything else not at all."""
    return (
        F.when(kind == ACCOUNT_CREDIT, amount)
        .when(kind == ACCOUNT_DEBIT, -amount)
        .otherwise(F.lit(0).cast("decimal(18,2)"))
    )


def agg_balance(events: DataFrame) -> DataFrame:
    signed = signed_amount(F.col("type"), F.col("amount"))
    return events.groupBy("account_id").agg(F.sum(signed).alias("balance"))


def agg_count_sum(rides: DataFrame, key: str = "city", amount: str = "fare") -> DataFrame:
    """Rides and total fare per city. Fares add up as decimals, so that the total
    does not depend on the order of the rows."""
    fare = F.col(amount).cast("decimal(18,2)")
    return rides.groupBy(key).agg(
        F.count("*").alias("rides"), F.sum(fare).alias("total_fare")
    )


def agg_profile(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(
        F.count("*").alias("event_count"),
        F.max_by("action", "offset").alias("last_action"),
    )


# Tables of hot keys and of their slices are broadcast up to so many rows, some MB.
SMALL_TABLE = 200_000
SLICES = 8


def _hot_keys(df: DataFrame, key: str, order: str, chunk: int) -> DataFrame:
    """(_key, _low, _width, _slices) of every key with more than ``chunk`` rows: its
    order values are cut into slices of equal width, some for every chunk."""
    sizes = df.groupBy(F.col(key).alias("_key")).agg(
        F.count("*").alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high"))
    slices = F.ceil(F.col("_n") / chunk) * SLICES
    return sizes.filter(F.col("_n") > chunk).select(
        "_key", "_low", F.ceil((F.col("_high") - F.col("_low") + 1) / slices).alias("_width"),
        slices.alias("_slices"))


def in_chunks(df: DataFrame, key: str, order: str, chunk: int = CHUNK) -> tuple[DataFrame, bool]:
    """``df`` with ``_chunk`` and ``_inner``, null for keys of at most ``chunk`` rows, and
    whether there are others.

    From the counts of a hot key's slices, neighbouring ones make up a chunk; a slice
    that holds more than ``chunk`` rows by itself is cut by its order values, which
    are unique. Counting the hot keys is a job of its own, as without any nothing
    further needs to be planned.
    """
    hot = _hot_keys(df, key, order, chunk)
    keys, slices = hot.agg(F.count("*"), F.sum("_slices")).first()
    if not keys:
        none = F.lit(None).cast("long")
        return df.withColumns({"_chunk": none, "_inner": none}), False

    def small(table: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(table) if rows <= SMALL_TABLE else table

    hot = small(hot.select("_key", "_low", "_width"), keys)
    same = F.col(key).eqNullSafe(F.col("_key"))
    at = F.floor((F.col(order) - F.col("_low")) / F.col("_width")).alias("_slice")
    counts = df.join(hot, same).groupBy("_key", at).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    chunks = counts.select(F.col("_key").alias("_cut_key"), F.col("_slice").alias("_cut_slice"), F.floor(
        F.coalesce(F.sum("_rows").over(before), F.lit(0)) / chunk).alias("_chunk"),
        (F.col("_rows") > chunk).alias("_dense"))
    sliced = df.join(hot, same, "left").withColumn("_slice", at)
    placed = sliced.join(small(chunks, slices), F.col("_key").eqNullSafe(F.col("_cut_key"))
                         & (F.col("_slice") == F.col("_cut_slice")), "left")
    inner = F.when(F.col("_dense"), F.col(order) - F.pmod(F.col(order), F.lit(chunk)))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], "_chunk", inner.alias("_inner")), True


def running_sum(
    df: DataFrame, key: str, order: str, value: Column, out: str, chunk: int = CHUNK,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Add the sum of ``value`` over the key's rows up to and including each row.

    ``order`` must be an integer column that is unique within the key; rows with a
    null key are one key like any other. ``initial`` holds, per key, an ``out``
    value to start from. Keys that are not hot take one window and nothing else.
    """
    placed, hot = in_chunks(df.withColumn("_value", value), key, order, chunk)
    upto = (
        Window.partitionBy(key, "_chunk", "_inner").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = placed.withColumn("_inside", F.sum("_value").over(upto))
    total = F.col("_inside")
    if hot:
        before = Window.partitionBy("_key").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
        carry = placed.filter("_chunk IS NOT NULL").groupBy(
            F.col(key).alias("_key"), F.col("_chunk").alias("_at"), F.col("_inner").alias("_in")).agg(
            F.sum("_value").alias("_total"), F.min(order).alias("_first")) \
            .select("_key", "_at", "_in", F.sum("_total").over(before).alias("_carry"))
        rows = rows.join(carry, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_at"))
                         & F.col("_inner").eqNullSafe(F.col("_in")), "left").drop("_key")
        total = total + F.coalesce(F.col("_carry"), F.lit(0))
    if initial is not None:
        start = initial.select(F.col(key).alias("_start_key"), F.col(out).alias("_start"))
        rows = rows.join(start, F.col(key).eqNullSafe(F.col("_start_key")), "left")
        total = total + F.coalesce(F.col("_start"), F.lit(0))
    return rows.withColumn(out, total).select(*[F.col(f"`{c}`") for c in df.columns], out)


def running_profile(events: DataFrame, chunk: int = CHUNK,
                    initial: DataFrame | None = None) -> DataFrame:
    """One profile per event: the count so far, and the action just seen.

    ``initial`` holds the ``event_count`` each user starts from.
    """
    counted = running_sum(events, "user_id", "offset", F.lit(1).cast("long"),
                          "event_count", chunk, initial)
    return counted.select("offset", "user_id", "event_count",
                          F.col("action").alias("last_action"))


def running_balance(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The account's balance after each replayed event."""
    signed = signed_amount(F.col("type"), F.col("amount")).cast("decimal(18,2)")
    return running_sum(events, "account_id", "offset", signed, "balance", chunk).select(
        "offset", "account_id", "type", "amount", "balance"
    )


def cdc_changes_by_key(changes: DataFrame, order: str = "offset") -> DataFrame:
    """Fold valid changes to one row per customer, in a form that can be merged.

    ``upsert_at`` is null for a customer only ever deleted. ``order`` decides
    which change is the last: ``offset`` for arrival, ``version`` for origin.
    """
    upsert_at = F.when(F.col("operation").isin(OP_CREATE, OP_UPDATE), F.col(order))
    return (
        changes.filter(F.col("operation").isin(OP_CREATE, OP_UPDATE, OP_DELETE))
        .groupBy("customer_id")
        .agg(
            F.max_by("email", upsert_at).alias("email"),
            F.max(upsert_at).alias("upsert_at"),
            F.max(F.col(order)).alias("changed_at"),
        )
    )


def cdc_merge(parts: DataFrame) -> DataFrame:
    """Merge the folds of several sets of changes into one."""
    return parts.groupBy("customer_id").agg(
        F.max_by("email", "upsert_at").alias("email"),
        F.max("upsert_at").alias("upsert_at"),
        F.max("changed_at").alias("changed_at"),
    )


def cdc_read_model(folded: DataFrame) -> DataFrame:
    """Rows exist once created; a delete marks them and keeps the email."""
    return folded.filter(F.col("upsert_at").isNotNull()).select(
        "customer_id",
        "email",
        (F.col("changed_at") > F.col("upsert_at")).alias("is_deleted"),
    )


def agg_cdc_fold(changes: DataFrame, order: str = "offset") -> DataFrame:
    return cdc_read_model(cdc_changes_by_key(changes, order))


def upsert_match(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert or update by key: incoming rows replace the current rows they match."""
    values = [c for c in current.columns if c != key]
    joined = current.alias("c").join(incoming.withColumn("_new", F.lit(True)).alias("n"),
                                     key, "full_outer")
    return joined.select(
        key,
        *[F.when(F.col("_new"), F.col(f"n.{v}")).otherwise(F.col(f"c.{v}")).alias(v)
          for v in values],
    )
