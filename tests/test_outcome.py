"""Outcomes, retries, sagas, windows and correlation."""

from datetime import datetime, timedelta, timezone
from decimal import Decimal as D

import pandas as pd
from pyspark.sql import functions as F

from streamops.operators import correlate, outcome, saga
from streamops.operators.windows import agg_tumbling_count


def jobs(spark, *names):
    return spark.createDataFrame([(n, 1280) for n in names], "image_id string, target_width int")


def test_jobs(spark, rows):
    names = [f"img-{i:03d}.jpg" for i in range(1, 13)] + ["notes-013.txt"]
    done = outcome.apply_strategy(jobs(spark, *names), outcome.classify_job(F.col("image_id")))
    branches = outcome.route_outcome(done)
    assert branches["success"].count() == 12 and branches["transient"].count() == 0
    assert rows(branches["poison"], "image_id", "error") == [
        ("notes-013.txt", "no decoder for this file type")]


def test_suffix_ignores_case_and_poison_comes_before_saturation(spark, rows):
    strategy = outcome.classify_job(F.col("image_id"), saturated=F.col("target_width") > 0)
    done = outcome.apply_strategy(jobs(spark, "a.JPG", "b.txt"), strategy)
    assert rows(done, "image_id", "outcome", "error") == [
        ("a.JPG", "transient", "resize pool saturated"),
        ("b.txt", "poison", "no decoder for this file type")]


def test_a_pandas_udf_can_be_the_strategy(spark, rows):
    @F.pandas_udf(outcome.RESULT_TYPE)
    def strategy(names: pd.Series) -> pd.DataFrame:
        good = names.str.endswith(".jpg")
        return pd.DataFrame({"outcome": good.map({True: "success", False: "poison"}),
                             "error": good.map({True: None, False: "no"})})

    done = outcome.apply_strategy(jobs(spark, "a.jpg", "b"), strategy("image_id"))
    assert rows(done, "image_id", "outcome", "error") == [
        ("a.jpg", "success", None), ("b", "poison", "no")]


def webhooks(spark):
    return spark.createDataFrame(
        [("wh-1", "https://ok.example.com/hook"), ("wh-2", "https://always-500.example.com/x"),
         ("wh-3", "https://ok.example.com/hook")], "id string, url string")


def test_webhooks(spark, rows):
    done = outcome.bounded_retry(webhooks(spark),
                                 lambda n: outcome.classify_delivery(F.col("url")))
    assert rows(done, "id", "outcome", "attempts", "waited_ms") == [
        ("wh-1", "success", 1, 0), ("wh-2", "transient", 3, 600), ("wh-3", "success", 1, 0)]
    assert rows(outcome.dead_letters(done, "id", F.col("url"))) == [
        ("wh-2", "https://always-500.example.com/x", 3,
         "endpoint returned 500 Internal Server Error")]


def test_retry_stops_at_success_and_at_poison(spark, rows):
    df = spark.createDataFrame([("ok2",), ("bad2",), ("ok3",), ("never",)], "id string")

    def attempt(n):
        name = F.col("id")
        return (
            F.when((name == "ok2") & F.lit(n >= 2), outcome.succeeded())
            .when((name == "bad2") & F.lit(n >= 2), outcome.failed("poison", "bad"))
            .when((name == "ok3") & F.lit(n >= 3), outcome.succeeded())
            .otherwise(outcome.failed("transient", F.lit(f"try {n}")))
        )

    done = outcome.bounded_retry(df, attempt)
    assert rows(done) == [
        ("bad2", "poison", "bad", 2, 200), ("never", "transient", "try 3", 3, 600),
        ("ok2", "success", None, 2, 200), ("ok3", "success", None, 3, 600)]


def test_live_retries_call_again_for_transient_rows_only(spark, rows):
    def call(urls: pd.Series) -> pd.DataFrame:
        assert not (len(urls) < 3 and (urls == "ok").any())
        return pd.DataFrame({"outcome": urls.map({"ok": "success", "down": "transient",
                                                  "bad": "poison"}),
                             "error": urls.map({"ok": None, "down": "500", "bad": "400"})})

    df = spark.createDataFrame([("ok",), ("down",), ("bad",)], "url string").coalesce(1)
    done = df.withColumn("r", outcome.retrying_udf(call, wait_ms=1)("url"))
    assert rows(done, "url", "r.outcome", "r.error", "r.attempts") == [
        ("bad", "poison", "400", 1), ("down", "transient", "500", 3), ("ok", "success", None, 1)]


def test_saga(spark, rows):
    orders = spark.createDataFrame([("ORD-1", "in-stock-item"), ("ORD-2", "rare-item")],
                                   "id string, item string")
    log = saga.saga_choreography(orders, "id", F.col("item"))
    assert rows(log, "order_id", "seq", "step", "status") == [
        ("ORD-1", 1, "order.created", "in-stock-item"),
        ("ORD-1", 2, "payment.captured", "in-stock-item"),
        ("ORD-1", 3, "order.completed", "ok"),
        ("ORD-2", 1, "order.created", "rare-item"),
        ("ORD-2", 2, "payment.captured", "rare-item"),
        ("ORD-2", 3, "inventory.failed", "failed"),
        ("ORD-2", 4, "order.cancelled", "refunded")]
    final = [("ORD-1", "order.completed", "ok", None),
             ("ORD-2", "order.cancelled", "refunded", "out of stock")]
    assert rows(saga.agg_saga_final(log)) == final
    assert rows(saga.agg_saga_final(log, order_by="seq")) == final


def test_saga_steps_chained_as_tables_give_the_same_log(spark, rows):
    created = spark.createDataFrame(
        [("1", "order.created", "rare-item", None), ("2", "order.created", None, None)],
        "order_id string, step string, status string, reason string")
    paid = saga.saga_step(created, saga.payment_service)
    reserved = saga.saga_step(paid, saga.inventory_service)
    cancelled = saga.saga_step(reserved, saga.payment_service)
    assert rows(cancelled) == [("1", "order.cancelled", "refunded", "out of stock")]
    assert rows(reserved, "order_id", "step") == [("1", "inventory.failed"),
                                                  ("2", "order.completed")]


T0 = datetime(2024, 1, 1, 12, 0, 0, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_tumbling_count(spark, rows):
    views = spark.createDataFrame(
        [("/home", at(0)), ("/home", at(4.999)), ("/home", at(5)), ("/docs", at(1))],
        "page string, at timestamp")
    got = rows(agg_tumbling_count(views), "page",
               F.unix_timestamp("window_start") - int(T0.timestamp()),
               F.unix_timestamp("window_end") - int(T0.timestamp()), "views")
    assert got == [("/docs", 0, 5, 1), ("/home", 0, 5, 2), ("/home", 5, 10, 1)]


def requests(spark, *values):
    return spark.createDataFrame(values, "correlation_id string, sku string, req_ts timestamp")


def replies(spark, *values):
    return spark.createDataFrame(
        values, "correlation_id string, reply_ts timestamp, reply_offset long, "
                "total decimal(18,2)")


def test_correlation(spark, rows):
    asked = requests(spark, ("a", "K", at(0)), ("b", "K", at(0)), ("c", "K", at(0)),
                     ("d", "K", at(10)), ("e", "K", at(0)))
    came = replies(
        spark,
        ("a", at(2), 2, D(2)), ("a", at(1), 1, D(1)), ("a", at(1), 9, D(9)),
        ("b", at(5), 3, D(3)), ("c", at(5.001), 4, D(4)),
        ("d", at(9), 5, D(5)), ("d", at(11), 6, D(6)),
        ("x", at(1), 7, D(7)), (None, at(1), 8, D(8)))
    assert rows(correlate.join_correlation(asked, came), "correlation_id", "total", "outcome",
                "error") == [
        ("a", D("1.00"), "success", None), ("b", D("3.00"), "success", None),
        ("c", None, "transient", "no reply for K within 5s"),
        ("d", D("6.00"), "success", None),
        ("e", None, "transient", "no reply for K within 5s")]
    assert rows(correlate.anti_unknown_reply(asked, came), "reply_offset") == [
        (2,), (4,), (5,), (7,), (8,), (9,)]


def test_replies_to_a_hot_id_are_split(spark):
    """With small limits, adaptive execution must report a skewed join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "30000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(0, 40_000, 1, 8).withColumn(
            "correlation_id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
                F.col("id").cast("string")))
        base = F.lit(T0)
        answers = ids.select(
            "correlation_id", F.timestamp_seconds(F.unix_timestamp(base) + F.col("id") % 5)
            .alias("reply_ts"), F.col("id").alias("reply_offset"),
            F.col("id").cast("decimal(18,2)").alias("total"))
        asked = ids.filter("correlation_id <> 'hot' OR id = 0").select(
            "correlation_id", F.lit("K").alias("sku"), base.alias("req_ts"))
        won = correlate.answered(asked, answers)
        assert won.count() == ids.select("correlation_id").distinct().count()
        won.collect()
        plan = won._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
