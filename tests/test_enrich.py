"""Lookups, enrichment, filters and validation on literal inputs."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from streamops.functions.codec import make_headers
from streamops.operators import enrich, outcome


def payments(spark, *values):
    return spark.createDataFrame(values, "payment_id string, currency string, amount decimal(18,2)")


def test_payments(spark, rows):
    raw = payments(spark, ("PAY-1", "USD", D(250)), ("PAY-2", "EUR", D(1200)),
                   ("PAY-3", "UAH", D(45000)), ("PAY-4", "USD", D(3100)))
    done = enrich.enrich_payments(raw, enrich.usd_rates(spark))
    assert rows(done, "payment_id", F.col("amount_usd").cast("decimal(18,2)"), "risk_level",
                "outcome") == [
        ("PAY-1", D("250.00"), "LOW", "success"), ("PAY-2", D("1308.00"), "HIGH", "success"),
        ("PAY-3", D("1080.00"), "HIGH", "success"), ("PAY-4", D("3100.00"), "HIGH", "success"),
    ]


def test_exactly_one_thousand_is_low(spark, rows):
    raw = payments(spark, ("a", "USD", D("1000.00")), ("b", "USD", D("1000.01")))
    done = enrich.enrich_payments(raw, enrich.usd_rates(spark))
    assert rows(done, "payment_id", "risk_level") == [("a", "LOW"), ("b", "HIGH")]


def test_unknown_and_missing_currency_are_poison(spark, rows):
    raw = payments(spark, ("a", "GBP", D(1)), ("b", None, D(2)), ("c", "usd", D(3)))
    done = enrich.enrich_payments(raw, enrich.usd_rates(spark))
    assert rows(done, "payment_id", "outcome", "risk_level", "error") == [
        ("a", "poison", None, "no USD rate for currency 'GBP'"),
        ("b", "poison", None, "no USD rate for currency ''"),
        ("c", "poison", None, "no USD rate for currency 'usd'"),
    ]
    assert outcome.route_outcome(done)["success"].count() == 0


def test_fare_of_exactly_ten_is_excluded(spark, rows):
    rides = spark.createDataFrame(
        [("kyiv", "R-1", 8.50), ("kyiv", "R-2", 14.20), ("lviv", "R-3", 11.00),
         ("kyiv", "R-4", 22.75), ("lviv", "R-5", 10.00)],
        "city string, ride_id string, fare double")
    assert rows(enrich.filter_threshold(rides), "ride_id") == [("R-2",), ("R-3",), ("R-4",)]


def test_prices(spark, rows):
    requests = spark.createDataFrame(
        [("SKU-KEYBOARD", 3), ("SKU-MONITOR", 2), ("SKU-CHAIR", 1)], "sku string, quantity int")
    prices = enrich.price_list(spark)
    assert rows(enrich.join_price_lookup(requests, prices), "sku", "total") == [
        ("SKU-KEYBOARD", D("239.97")), ("SKU-MONITOR", D("698.00"))]
    assert rows(enrich.unpriced_requests(requests, prices), "sku", "outcome", "error") == [
        ("SKU-CHAIR", "transient", "no price for SKU-CHAIR")]


def test_address_check_reports_the_reply_address_first(spark, rows):
    requests = spark.createDataFrame(
        [("a", "r", "1"), ("b", None, "2"), ("c", "r", None), ("d", None, None)],
        "id string, reply_to string, correlation_id string",
    ).select("id", make_headers(reply_to=F.col("reply_to"),
                                correlation_id=F.col("correlation_id")).alias("headers"))
    assert rows(enrich.address_check(requests), "id", "error") == [
        ("a", None), ("b", "header 'reply-to' is missing"),
        ("c", "header 'correlation-id' is missing"), ("d", "header 'reply-to' is missing")]
    assert rows(enrich.addressable(requests), "id", "reply_to", "correlation_id") == [
        ("a", "r", "1")]


@pytest.mark.parametrize("op,action", [("c", "index"), ("u", "reindex"), ("d", "drop"),
                                       ("x", "unknown op"), (None, "unknown op")])
def test_cdc_action(spark, op, action):
    df = spark.createDataFrame([(op,)], "op string")
    assert df.select(enrich.cdc_action(F.col("op"))).first()[0] == action


def test_cdc_validate(spark, rows):
    df = spark.createDataFrame([("Create",), ("Merge",), (None,)], "operation string")
    assert rows(enrich.cdc_validate(df)) == [
        ("Create", "success", None), ("Merge", "poison", "unknown CDC operation 'Merge'"),
        (None, "poison", "unknown CDC operation ''")]
