"""A saga as a stateless chain: each service turns one message into the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamops.constants import (
    ITEM_RARE,
    OUT_OF_STOCK,
    STATUS_FAILED,
    STATUS_OK,
    STATUS_REFUNDED,
    STEP_INVENTORY_FAILED,
    STEP_ORDER_CANCELLED,
    STEP_ORDER_COMPLETED,
    STEP_ORDER_CREATED,
    STEP_PAYMENT_CAPTURED,
)

FINAL_STEPS = (STEP_ORDER_COMPLETED, STEP_ORDER_CANCELLED)
_FIELDS = ("order_id", "step", "status", "reason")


def message(order_id: Column, step: str, status: Column, reason: Column | None = None) -> Column:
    why = F.lit(None).cast("string") if reason is None else reason
    values = (order_id, F.lit(step), status, why)
    return F.struct(*[v.alias(n) for n, v in zip(_FIELDS, values)])


def payment_service(m: Column) -> Column:
    """Charge a new order; refund one whose reservation failed."""
    return F.when(
        m["step"] == STEP_ORDER_CREATED,
        message(m["order_id"], STEP_PAYMENT_CAPTURED, m["status"]),
    ).when(
        m["step"] == STEP_INVENTORY_FAILED,
        message(m["order_id"], STEP_ORDER_CANCELLED, F.lit(STATUS_REFUNDED), m["reason"]),
    )


def inventory_service(m: Column) -> Column:
    """Reserve a paid order's item, or report that it is out of stock."""
    paid = m["step"] == STEP_PAYMENT_CAPTURED
    rare = F.coalesce(m["status"] == ITEM_RARE, F.lit(False))
    return F.when(
        paid & rare,
        message(m["order_id"], STEP_INVENTORY_FAILED, F.lit(STATUS_FAILED), F.lit(OUT_OF_STOCK)),
    ).when(
        paid, message(m["order_id"], STEP_ORDER_COMPLETED, F.lit(STATUS_OK))
    )


def saga_step(df: DataFrame, service) -> DataFrame:
    """Messages one service emits for the messages of ``df``."""
    nxt = service(F.struct(*[F.col(c) for c in _FIELDS]))
    return df.select(nxt.alias("m")).filter("m IS NOT NULL").select("m.*")


# The topics that carry each step, and which services read them.
TOPICS = {
    STEP_ORDER_CREATED: "orders",
    STEP_PAYMENT_CAPTURED: "payments",
    STEP_INVENTORY_FAILED: "inventory",
    STEP_ORDER_COMPLETED: "results",
    STEP_ORDER_CANCELLED: "results",
}


def topic_of(step: Column) -> Column:
    pairs = [F.lit(x) for pair in TOPICS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), step)


def orders_created(orders: DataFrame, order_id: str, item: Column) -> DataFrame:
    """The first message of every order's saga, with its topic."""
    created = message(F.col(order_id).cast("string"), STEP_ORDER_CREATED, item)
    return orders.select(created.alias("m")).select(
        F.lit(1).alias("seq"), "m.*", F.lit(TOPICS[STEP_ORDER_CREATED]).alias("topic"))


def saga_stage(messages: DataFrame, service) -> DataFrame:
    """What one service emits for the messages of its topics, each with the topic it
    goes to and, as ``seq``, its number in the order's saga."""
    nxt = service(F.struct(*[F.col(c) for c in _FIELDS]))
    return messages.select((F.col("seq") + 1).alias("seq"), nxt.alias("m")).filter("m IS NOT NULL").select(
        "seq", "m.*", topic_of(F.col("m.step")).alias("topic"))


def saga_choreography(orders: DataFrame, order_id: str, item: Column) -> DataFrame:
    """Every message of every order's saga, numbered in the order of emission.

    An order needs at most four messages, so the whole chain is a projection and
    one explode: a single scan without a shuffle.
    """
    created = message(F.col(order_id).cast("string"), STEP_ORDER_CREATED, item)
    chain = orders.select(created.alias("m1"))
    for n, service in ((2, payment_service), (3, inventory_service), (4, payment_service)):
        chain = chain.withColumn(f"m{n}", service(F.col(f"m{n - 1}")))
    return (
        chain.select(F.posexplode(F.array("m1", "m2", "m3", "m4")).alias("seq", "m"))
        .filter("m IS NOT NULL")
        .select((F.col("seq") + 1).alias("seq"), "m.*")
    )


def agg_saga_final(log: DataFrame, order_by: str | None = None) -> DataFrame:
    """Final message per order.

    Without ``order_by`` this reads the results log, which holds one final
    message per order; with it, it audits a full log by taking the last message.
    """
    if order_by is None:
        return log.filter(F.col("step").isin(*FINAL_STEPS)).select(*_FIELDS)
    last = F.max_by(F.struct("step", "status", "reason"), F.col(order_by))
    return log.groupBy("order_id").agg(last.alias("m")).select("order_id", "m.*")
