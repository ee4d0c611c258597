"""Pairing of requests with replies by correlation id."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamops.constants import REPLY_TIMEOUT_SECONDS, SUCCESS, TRANSIENT


def _within(timeout_seconds: int):
    limit = F.col("req_ts") + F.expr(f"INTERVAL {timeout_seconds} SECONDS")
    return F.col("reply_ts").between(F.col("req_ts"), limit)


def first_reply(pairs: DataFrame, *request: str) -> DataFrame:
    """The earliest reply per request, ties broken by the reply's offset.

    ``request`` names the columns that tell requests apart; several requests may
    share a correlation id.
    """
    keys = request or ("correlation_id",)
    reply = F.min(F.when(F.col("reply_ts").isNotNull(),
                         F.struct("reply_ts", "reply_offset", "total"))).alias("r")
    return pairs.groupBy(*keys).agg(reply).select(*keys, "r.*")


def _slot(ts: str, timeout_seconds: int, later: int = 0):
    return F.floor(F.unix_micros(ts) / F.lit(timeout_seconds * 1_000_000)) + later


def slotted_join(requests: DataFrame, replies: DataFrame, timeout_seconds: int,
                 how: str) -> DataFrame:
    """Requests with each reply inside their timeout.

    The key holds a time slot as long as the timeout next to the id, and a request
    waits in the two slots its replies can be in: of a hot id only neighbouring
    rows meet, and its rows spread over its slots.
    """
    slots = F.array(_slot("req_ts", timeout_seconds), _slot("req_ts", timeout_seconds, 1))
    left = requests.withColumn("slot", F.explode(slots)).alias("q")
    right = replies.withColumn("slot", _slot("reply_ts", timeout_seconds)).alias("r")
    same = (F.col("q.correlation_id") == F.col("r.correlation_id")) & (
        F.col("q.slot") == F.col("r.slot"))
    return left.join(right, same & _within(timeout_seconds), how).select(
        *[f"q.{c}" for c in requests.columns], "r.reply_ts", "r.reply_offset", "r.total"
    )


def answered(requests: DataFrame, replies: DataFrame,
             timeout_seconds: int = REPLY_TIMEOUT_SECONDS) -> DataFrame:
    """Winning reply per request: the first one inside the timeout."""
    pairs = slotted_join(requests, replies, timeout_seconds, "inner")
    return first_reply(pairs, *requests.columns)


def join_correlation(requests: DataFrame, replies: DataFrame,
                     timeout_seconds: int = REPLY_TIMEOUT_SECONDS) -> DataFrame:
    """Every request with its reply, or the transient outcome of a timeout: one
    join, one aggregate. Requests equal in every column are one request."""
    pairs = slotted_join(requests, replies, timeout_seconds, "left_outer")
    return settle_pairs(pairs, timeout_seconds)


def with_timeout(joined: DataFrame, timeout_seconds: int = REPLY_TIMEOUT_SECONDS) -> DataFrame:
    late = F.col("reply_ts").isNull()
    return joined.withColumns({
        "outcome": F.when(late, TRANSIENT).otherwise(SUCCESS),
        "error": F.when(late, F.concat(
            F.lit("no reply for "), F.col("sku"), F.lit(f" within {timeout_seconds}s"))),
    })


def anti_unknown_reply(requests: DataFrame, replies: DataFrame,
                       timeout_seconds: int = REPLY_TIMEOUT_SECONDS) -> DataFrame:
    """Replies nothing waits for: unknown, repeated, too late, or without an id."""
    winners = answered(requests, replies, timeout_seconds).select("correlation_id", "reply_offset")
    return replies.join(winners, ["correlation_id", "reply_offset"], "left_anti")


def join_correlation_stream(requests: DataFrame, replies: DataFrame, delay: str = "0 seconds",
                            timeout_seconds: int = REPLY_TIMEOUT_SECONDS) -> DataFrame:
    """Interval join of two streams; ``settle_pairs`` applies to what it emits.

    What comes out are pairs: a request found no reply in a slot comes out of that
    slot once the watermark has passed its timeout, so an answered request may
    have such a row too. ``settle_pairs`` gives one row per request.
    """
    return slotted_join(requests.withWatermark("req_ts", delay),
                        replies.select("correlation_id", "reply_ts", "reply_offset", "total")
                        .withWatermark("reply_ts", delay), timeout_seconds, "left_outer")


def settle_pairs(pairs: DataFrame, timeout_seconds: int = REPLY_TIMEOUT_SECONDS) -> DataFrame:
    """One row per request from what the streaming join has emitted."""
    request = [c for c in pairs.columns if c not in ("reply_ts", "reply_offset", "total")]
    return with_timeout(first_reply(pairs, *request), timeout_seconds)


def _closing_rows(closing: DataFrame, side: str, ts: str) -> DataFrame:
    """Rows that match nothing and move the watermark. Their ids are neither null
    nor constant, as the optimizer would drop such rows before the watermark."""
    return closing.select(F.concat(F.lit(f"closing of the {side} log at "), F.col("ts").cast("string"))
                          .alias("correlation_id"), F.col("ts").alias(ts))


def settled_stream(requests: DataFrame, replies: DataFrame, closing: DataFrame | None = None,
                   delay: str = "0 seconds",
                   timeout_seconds: int = REPLY_TIMEOUT_SECONDS) -> DataFrame:
    """One row per request, once, as soon as the watermark has passed its timeout:
    with its first reply, or as transient.

    A reply stands in its own time slot and the one before, a request in its own
    only, so a request is in one place and the outer join gives up on it once. The
    join is followed by an aggregate over the same watermark, in append mode.

    ``closing`` is a stream with the time (``ts``) before which no request or reply is
    to come any more, and so closes all that is still pending; see ``close_log``.
    """
    asked = requests
    came = replies.select("correlation_id", "reply_ts", "reply_offset", "total")
    if closing is not None:
        asked = asked.unionByName(_closing_rows(closing, "request", "req_ts"), allowMissingColumns=True)
        came = came.unionByName(_closing_rows(closing, "reply", "reply_ts"), allowMissingColumns=True)
    slots = F.array(_slot("reply_ts", timeout_seconds), _slot("reply_ts", timeout_seconds, -1))
    left = asked.withWatermark("req_ts", delay).withColumn("slot", _slot("req_ts", timeout_seconds)).alias("q")
    right = came.withWatermark("reply_ts", delay).withColumn("slot", F.explode(slots)).alias("r")
    same = (F.col("q.correlation_id") == F.col("r.correlation_id")) & (
        F.col("q.slot") == F.col("r.slot"))
    pairs = left.join(right, same & _within(timeout_seconds), "left_outer").select(
        *[f"q.{c}" for c in requests.columns], "r.reply_ts", "r.reply_offset", "r.total")
    return with_timeout(first_reply(pairs, *requests.columns), timeout_seconds)


def close_log(spark: SparkSession, path: str, at: datetime | None) -> None:
    """Close what reads the closing log ``path``, once; without a time, create the log."""
    rows = [] if at is None else [(at,)]
    spark.createDataFrame(rows, "ts timestamp").coalesce(1).write.mode("append").parquet(path)
