"""Lookups, enrichment and filters.

Lookup joins carry no broadcast hint: Spark broadcasts a lookup whose measured
size is below its threshold and otherwise falls back to a sort-merge join, whose
hot partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamops.constants import (
    HEADER_CORRELATION_ID,
    HEADER_REPLY_TO,
    HIGH_RISK_ABOVE_USD,
    OP_CREATE,
    OP_DELETE,
    OP_UPDATE,
    POISON,
    PRICE_LIST,
    RIDE_FARE_ABOVE,
    RISK_HIGH,
    RISK_LOW,
    SUCCESS,
    TRANSIENT,
    USD_RATES,
)
from streamops.functions.codec import header_get, make_headers, missing_header


def _inline_table(spark: SparkSession, values: Mapping[str, str], key: str, value: str,
                  value_type: str) -> DataFrame:
    names = F.explode(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]))
    pairs = spark.range(1).select(names.alias(key, value))
    return pairs.select(key, F.col(value).cast(value_type).alias(value))


def usd_rates(spark: SparkSession, rates: Mapping[str, str] = USD_RATES) -> DataFrame:
    return _inline_table(spark, rates, "currency", "rate", "decimal(18,6)")


def price_list(spark: SparkSession, prices: Mapping[str, str] = PRICE_LIST) -> DataFrame:
    return _inline_table(spark, prices, "sku", "unit_price", "decimal(18,2)")


def filter_threshold(df: DataFrame, column: str = "fare",
                     above: float = RIDE_FARE_ABOVE) -> DataFrame:
    """Rows strictly above the threshold."""
    return df.filter(F.col(column) > above)


def join_rate_lookup(payments: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``rate``, ``outcome`` and ``error``; a currency without rate is poison."""
    joined = payments.join(rates.select("currency", "rate"), "currency", "left")
    missing = F.col("rate").isNull()
    return joined.withColumns({
        "outcome": F.when(missing, POISON).otherwise(SUCCESS),
        "error": F.when(missing, F.concat(
            F.lit("no USD rate for currency '"), F.coalesce("currency", F.lit("")), F.lit("'"))),
    })


def enrich_usd(df: DataFrame, amount: str = "amount", rate: str = "rate") -> DataFrame:
    return df.withColumn("amount_usd", F.col(amount) * F.col(rate))


def risk_level(usd: Column) -> Column:
    return F.when(usd > HIGH_RISK_ABOVE_USD, RISK_HIGH).otherwise(RISK_LOW)


def enrich_payments(payments: DataFrame, rates: DataFrame) -> DataFrame:
    """The whole enrichment; poison rows stay, with null amount and risk."""
    rated = enrich_usd(join_rate_lookup(payments, rates))
    known = F.col("outcome") == SUCCESS
    return rated.withColumn("risk_level", F.when(known, risk_level(F.col("amount_usd"))))


def price_total(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.col("unit_price") * F.col("quantity"))


def join_price_lookup(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """One reply per request whose article has a price."""
    return price_total(requests.join(prices.select("sku", "unit_price"), "sku"))


def unpriced_requests(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Requests that get no reply: retryable, with the reason kept."""
    return requests.join(prices.select("sku"), "sku", "left_anti").withColumns({
        "outcome": F.lit(TRANSIENT),
        "error": F.concat(F.lit("no price for "), F.col("sku")),
    })


def address_check(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Add the two addresses and, where one is missing, the error naming it.

    The reply address is reported before the correlation id.
    """
    h = F.col(headers)
    read = df.withColumns({
        "reply_to": header_get(h, HEADER_REPLY_TO),
        "correlation_id": header_get(h, HEADER_CORRELATION_ID),
    })
    return read.withColumn("error", F.coalesce(
        missing_header(F.col("reply_to"), HEADER_REPLY_TO),
        missing_header(F.col("correlation_id"), HEADER_CORRELATION_ID),
    ))


def addressable(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Drop the requests nobody could be answered for."""
    return address_check(df, headers).filter(F.col("error").isNull()).drop("error")


def price_replies(requests: DataFrame, prices: DataFrame, headers: str = "headers") -> DataFrame:
    """The pricing service in one pass: every request with its outcome and, where
    it succeeds, the reply: ``topic`` as named by the request, ``reply_headers``
    with its correlation id, and ``total``.

    Requests nobody could be answered for are poison, those for an article without
    a price transient. One left join; prices hold an article at most once.
    """
    checked = address_check(requests, headers)
    priced = price_total(checked.join(prices.select("sku", "unit_price"), "sku", "left"))
    dropped, unknown = F.col("error").isNotNull(), F.col("unit_price").isNull()
    answered = ~dropped & ~unknown
    return priced.withColumns({
        "outcome": F.when(dropped, POISON).when(unknown, TRANSIENT).otherwise(SUCCESS),
        "error": F.when(dropped, F.col("error")).when(
            unknown, F.concat(F.lit("no price for "), F.col("sku"))),
        "topic": F.when(answered, F.col("reply_to")),
        "reply_headers": F.when(answered, make_headers(
            **{HEADER_CORRELATION_ID.replace("-", "_"): F.col("correlation_id")})),
        "total": F.when(answered, F.col("total")),
    })


def cdc_action(op: Column) -> Column:
    """What the index does for a change of kind c, u or d."""
    return (
        F.when(op == "c", "index").when(op == "u", "reindex").when(op == "d", "drop")
        .otherwise("unknown op")
    )


def cdc_validate(df: DataFrame, op: str = "operation") -> DataFrame:
    """Add ``outcome`` and ``error``; an operation nobody knows is poison."""
    known = F.coalesce(F.col(op).isin(OP_CREATE, OP_UPDATE, OP_DELETE), F.lit(False))
    return df.withColumns({
        "outcome": F.when(known, SUCCESS).otherwise(POISON),
        "error": F.when(~known, F.concat(
            F.lit("unknown CDC operation '"), F.coalesce(F.col(op), F.lit("")), F.lit("'"))),
    })
