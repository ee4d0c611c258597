"""Requests settled in the stream at their timeout; services over topics."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.operators import correlate, saga
from streamops.sources import log
from streamops.streaming.run import await_caught_up, drain, file_sink
from streamops.streaming.topology import OUTSIDE, Service, Topology

T0 = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
ASKED = "correlation_id string, sku string, req_ts timestamp"
CAME = "correlation_id string, reply_ts timestamp, reply_offset long, total decimal(18,2)"
COLUMNS = ("correlation_id", "sku", "req_ts", "reply_ts", "reply_offset", "total", "outcome", "error")


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def schema(text):
    return T._parse_datatype_string(text)


def settle(spark, folder, parts, closing):
    """Drain after every part (requests, replies) and, if asked, after a closing time."""
    asked, came, closed, out, checkpoint = map(folder, ("asked", "came", "closed", "out", "cp"))
    correlate.close_log(spark, closed, None)

    def go():
        rows = correlate.settled_stream(
            log.log_scan(spark, asked, schema(ASKED)), log.log_scan(spark, came, schema(CAME)),
            log.log_scan(spark, closed, schema("ts timestamp")), "10 seconds")
        drain(file_sink(rows, out, checkpoint), 120)
        return spark.read.schema(rows.schema).parquet(out)

    for requests, replies in parts:
        log.log_append(spark.createDataFrame(requests, ASKED).coalesce(1), asked)
        log.log_append(spark.createDataFrame(replies, CAME).coalesce(1), came)
        got = go()
    if closing is not None:
        correlate.close_log(spark, closed, closing)
        got = go()
    return got


def test_every_request_is_settled_once_by_timers_and_the_closing(spark, folder, rows):
    rng = random.Random(5)
    parts = []
    for part in range(3):
        base = part * 60
        requests = [(f"r{part}-{k}", "K", at(base + rng.random() * 50)) for k in range(30)]
        # Several requests under one id, in one slot and across two.
        requests += [("hot", f"H{k}", at(base + k * 0.7)) for k in range(20)]
        replies = [(i, ts + timedelta(seconds=rng.choice([-1, 0, 0.5, 3, 5, 5.001, 8])), n + part * 1000, D(n))
                   for n, (i, _, ts) in enumerate(requests * 2) if n % 5]
        parts.append((requests, replies + [("nobody", at(base), 9999, D(1))]))
    got = settle(spark, folder, parts, at(3600))
    expected = correlate.join_correlation(
        spark.createDataFrame([q for p in parts for q in p[0]], ASKED),
        spark.createDataFrame([r for p in parts for r in p[1]], CAME))
    assert rows(got, *COLUMNS) == rows(expected, *COLUMNS) and got.count() == 150
    assert 0 < got.filter("outcome = 'transient'").count() < 100


def test_without_a_closing_the_last_requests_stay_pending(spark, folder):
    parts = [([("a", "K", at(0))], [("a", at(1), 1, D(1))]), ([("b", "K", at(60))], [("x", at(60), 2, D(1))])]
    got = settle(spark, folder, parts, None)
    assert [(r.correlation_id, r.outcome) for r in got.collect()] == [("a", "success")]


MESSAGE = T.StructType([T.StructField("seq", T.IntegerType()), *[
    T.StructField(c, T.StringType()) for c in ("order_id", "step", "status", "reason")]])
SERVICES = [
    Service("payment", ("orders", "inventory"), (OUTSIDE, "inventory"),
            lambda df: saga.saga_stage(df, saga.payment_service)),
    Service("inventory", ("payments",), ("payment",), lambda df: saga.saga_stage(df, saga.inventory_service)),
]


def test_sagas_over_topics_survive_a_stop_anywhere(spark, folder, rows):
    root = folder("saga")
    orders = spark.createDataFrame([(f"ORD-{n}", "rare-item" if n % 3 == 0 else "in-stock-item")
                                    for n in range(40)], "id string, item string")
    first, second = orders.filter("id < 'ORD-2'"), orders.filter("id >= 'ORD-2'")
    topology = Topology(spark, root, MESSAGE, SERVICES)
    topology.publish(saga.orders_created(first, "id", F.col("item")))
    # Stopped after the payments of the first orders, before the inventory has seen them.
    await_caught_up(topology.writer(SERVICES[0]).trigger(availableNow=True).start(), 120)
    topology = Topology(spark, root, MESSAGE, SERVICES)
    topology.publish(saga.orders_created(second, "id", F.col("item")))
    assert topology.drain(120, most=9) == 3
    columns = ("order_id", "seq", "step", "status", "reason")
    expected = saga.saga_choreography(orders, "id", F.col("item"))
    assert rows(topology.messages(), *columns) == rows(expected, *columns)
    assert rows(topology.messages("results"), "order_id", "step", "status", "reason") == rows(
        saga.agg_saga_final(expected), "order_id", "step", "status", "reason")
    assert topology.drain(120) == 1


def test_messages_that_circle_for_ever_are_stopped(spark, folder):
    echo = Service("echo", ("a",), (OUTSIDE, "echo"), lambda df: df)
    topology = Topology(spark, folder("echo"), schema("n long"), [echo])
    topology.publish(spark.createDataFrame([(1, "a")], "n long, topic string"))
    with pytest.raises(RuntimeError):
        topology.drain(120, most=3)
    assert topology.messages("a").count() == 4
