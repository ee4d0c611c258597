"""Test tables in the shapes the operators read.

Every function takes ``stream``: the same projection then runs on a stream over
the table's files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.constants import (
    ACCOUNT_CREDIT,
    ACCOUNT_DEBIT,
    HEADER_CORRELATION_ID,
    HEADER_REPLY_TO,
    ITEM_IN_STOCK,
    ITEM_RARE,
    OP_CREATE,
    OP_DELETE,
    OP_UPDATE,
    OUTBOX_PENDING,
)
from streamops.functions.codec import make_headers

COLUMNS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str, name: str, stream: bool = False,
           **options: str) -> DataFrame:
    if not stream:
        return table(spark, sf_dir, name)
    # As a glob the path may name one file as well as a folder of files.
    path = f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(COLUMNS[name]).options(**options).parquet(path)


def events(spark: SparkSession, sf_dir: str, stream: bool = False, **options: str) -> DataFrame:
    """Events with a time-zoned timestamp, as watermarks need it."""
    raw = source(spark, sf_dir, "events", stream, **options)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def k_of(props: str = "props") -> Column:
    """The number every event carries in its JSON."""
    return F.get_json_object(props, "$.k").cast("int")


def money(col: str) -> Column:
    return F.col(col).cast("decimal(18,2)")


def page_views(spark, sf_dir, stream=False, **options) -> DataFrame:
    return events(spark, sf_dir, stream, **options).select(
        F.col("event_type").alias("page"), F.col("ts").alias("at")
    )


def account_events(spark, sf_dir, stream=False, **options) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "purchase", ACCOUNT_CREDIT)
        .when(F.col("event_type") == "error", ACCOUNT_DEBIT).otherwise("Opened")
    )
    return source(spark, sf_dir, "events", stream, **options).select(
        F.col("event_id").alias("offset"), F.col("user_id").alias("account_id"),
        kind.alias("type"), money("value").alias("amount"),
    )


def user_events(spark, sf_dir, stream=False, **options) -> DataFrame:
    return source(spark, sf_dir, "events", stream, **options).select(
        F.col("event_id").alias("offset"), "user_id", F.col("event_type").alias("action")
    )


def rides(spark, sf_dir, stream=False, **options) -> DataFrame:
    return source(spark, sf_dir, "events", stream, **options).select(
        F.col("event_type").alias("city"), F.col("event_id").alias("ride_id"),
        F.col("value").alias("fare"),
    )


def customer_regions(spark, sf_dir) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.col("r_name").alias("region"))


def payments(spark, sf_dir) -> DataFrame:
    """Orders as payments in the currency of the customer's region."""
    region = F.col("region")
    currency = (
        F.when(region == "AMERICA", "USD").when(region == "EUROPE", "EUR")
        .when(region == "ASIA", "UAH").when(region == "AFRICA", "XOF").otherwise("AED")
    )
    return table(spark, sf_dir, "orders").join(
        customer_regions(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")
    ).select(F.col("o_orderkey").alias("payment_id"), currency.alias("currency"),
             money("o_totalprice").alias("amount"))


def payment_stream(spark, sf_dir, **options) -> DataFrame:
    """Orders as payments in a currency that follows from the priority."""
    priority = F.col("o_orderpriority")
    currency = (
        F.when(priority == "1-URGENT", "USD").when(priority == "2-HIGH", "EUR")
        .when(priority == "3-MEDIUM", "UAH").otherwise("XOF")
    )
    return source(spark, sf_dir, "orders", True, **options).select(
        F.col("o_orderkey").alias("payment_id"), currency.alias("currency"),
        money("o_totalprice").alias("amount"),
    )


def changes(spark, sf_dir, stream=False, **options) -> DataFrame:
    kind = F.col("event_type")
    operation = (
        F.when(kind == "signup", OP_CREATE).when(kind.isin("click", "purchase"), OP_UPDATE)
        .when(kind == "error", OP_DELETE).otherwise("Unknown")
    )
    return source(spark, sf_dir, "events", stream, **options).select(
        F.col("event_id").alias("offset"), operation.alias("operation"),
        F.col("user_id").alias("customer_id"), F.col("props").alias("email"),
        F.col("event_id").alias("version"),
    )


def requests_of(rows: DataFrame) -> DataFrame:
    """All events but the errors ask for a price."""
    return rows.filter("event_type <> 'error'").select(
        F.col("event_id").cast("string").alias("correlation_id"),
        F.col("event_type").alias("sku"), F.col("ts").alias("req_ts"),
    )


def requests(spark, sf_dir, stream=False, **options) -> DataFrame:
    return requests_of(events(spark, sf_dir, stream, **options))


def replies_of(rows: DataFrame) -> DataFrame:
    """All events but sign-ups are answered, after 80 ms times ``k``.

    Purchases are answered a second time one second later, and errors although
    nobody asked.
    """
    copies = F.when(F.col("event_type") == "purchase", F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    answers = rows.filter("event_type <> 'signup'")
    return answers.withColumns({"k": k_of(), "copy": F.explode(copies)}).select(
        F.col("event_id").cast("string").alias("correlation_id"),
        F.expr("timestampadd(MILLISECOND, k * 80 + copy * 1000, ts)").alias("reply_ts"),
        (F.col("event_id") * 2 + F.col("copy")).alias("reply_offset"),
        (money("value") * (F.col("copy") + 1)).cast("decimal(18,2)").alias("total"),
    )


def replies(spark, sf_dir, stream=False, **options) -> DataFrame:
    return replies_of(events(spark, sf_dir, stream, **options))


def content() -> Column:
    """Event JSON, cut short for errors so that it cannot be decoded."""
    props = F.col("props")
    return F.when(F.col("event_type") == "error",
                  F.substring(props, F.lit(1), F.length(props) - 1)).otherwise(props)


CONTENT_SCHEMA = T.StructType([T.StructField("k", T.LongType())])


def outbox(spark, sf_dir) -> DataFrame:
    null_text = F.lit(None).cast("string")
    return events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_id").alias("sequence"),
        F.concat(F.lit("cdc."), "event_type").alias("topic"),
        F.lit("Customer").alias("entity_type"),
        F.col("user_id").cast("string").alias("entity_id"),
        content().alias("content"),
        F.col("ts").alias("occurred_on"),
        F.lit(None).cast("timestamp").alias("processed_on"),
        F.lit(OUTBOX_PENDING).alias("state"),
        (k_of() % 3).cast("int").alias("retry_count"),
        null_text.alias("error"),
        "value",
    )


def saga_orders(spark, sf_dir, stream=False, **options) -> DataFrame:
    item = F.when(F.col("o_orderpriority") == "1-URGENT", ITEM_RARE).otherwise(ITEM_IN_STOCK)
    return source(spark, sf_dir, "orders", stream, **options).select(
        "o_orderkey", item.alias("item")
    )


def addressed_requests(spark, sf_dir) -> DataFrame:
    """Views carry no reply address, events with a small ``k`` no correlation id."""
    ids = {
        HEADER_CORRELATION_ID.replace("-", "_"):
            F.when(k_of() >= 20, F.col("event_id").cast("string")),
        HEADER_REPLY_TO.replace("-", "_"):
            F.when(F.col("event_type") != "view", F.concat(F.lit("replies."), "event_type")),
    }
    return table(spark, sf_dir, "events").select("event_id", make_headers(**ids).alias("headers"))
