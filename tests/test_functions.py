"""Text expressions, codecs and partition assignment."""

import zlib
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.functions import codec, partitioning, text


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text(spark):
    assert one(spark, text.has_suffix(F.lit("A.JPG"), ".jpg"))
    assert not one(spark, text.has_suffix(F.lit("a.jpg.txt"), ".jpg"))
    assert one(spark, text.money_text(F.lit(430))) == "430.00"
    assert one(spark, text.zero_padded(F.lit(7), 4)) == "0007"
    assert one(spark, text.zero_padded(F.lit(12345), 4)) == "12345"
    assert one(spark, text.left_aligned(F.lit("eu"), 5)) == "eu   "
    assert one(spark, text.left_aligned(F.lit("dev-123"), 6)) == "dev-123"
    assert one(spark, text.round_half_even(F.lit(0.25), 1)) == 0.2
    assert one(spark, text.round_half_even(F.lit(0.75), 1)) == 0.8


def test_window_texts(spark):
    start = F.lit(datetime(2024, 1, 1, 9, 5, 0, tzinfo=timezone.utc))
    end = F.lit(datetime(2024, 1, 1, 9, 5, 5, tzinfo=timezone.utc))
    assert one(spark, text.window_label(F.lit("/home"), start, end, F.lit(3))) == \
        "[09:05:00-09:05:05] /home: 3 views"
    ts = F.timestamp_millis(F.lit(12_345))
    assert one(spark, text.window_start_ms(ts, 5000)) == 10_000
    line = text.log_line(F.lit("ORD-1"), F.lit("order.completed"), F.lit("ok"),
                         F.lit(None).cast("string"))
    assert one(spark, line) == "ORD-1 FINAL: order.completed (ok)"
    line = text.log_line(F.lit("ORD-2"), F.lit("order.cancelled"), F.lit("refunded"),
                         F.lit("out of stock"))
    assert one(spark, line) == "ORD-2 FINAL: order.cancelled (refunded, out of stock)"


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def test_decode_or_poison_keeps_every_row(spark, rows):
    values = ['{"id": 1, "name": "a"}', '{"id": 2}', "{bad", "", None, "null", '{"id": "x"}',
              '{"id": 3, "extra": true}']
    df = spark.createDataFrame(list(enumerate(values)), "n int, value string")
    got = rows(codec.decode_or_poison(df, SCHEMA), "n", "id", "name", "outcome", "error")
    bad = "Failed to deserialize"
    assert got == [
        (0, 1, "a", "success", None), (1, 2, None, "success", None),
        (2, None, None, "poison", bad), (3, None, None, "poison", bad),
        (4, None, None, "poison", bad), (5, None, None, "poison", bad),
        (6, None, None, "poison", bad), (7, 3, None, "success", None)]


def test_decode_polymorphic(spark, rows):
    values = ['{"$type": "A", "id": 1}', '{"$type": "B", "id": 2, "name": "b"}',
              '{"$type": "C", "id": 3}', '{"id": 4}', '{"$type": "A", "id": "x"}', "{bad"]
    df = spark.createDataFrame(list(enumerate(values)), "n int, content string")
    done = codec.decode_polymorphic(df, {"A": SCHEMA, "B": SCHEMA})
    assert rows(done, "n", "A.id", "B.name", "outcome") == [
        (0, 1, None, "success"), (1, None, "b", "success"), (2, None, None, "poison"),
        (3, None, None, "poison"), (4, None, None, "poison"), (5, None, None, "poison")]


def test_headers(spark):
    headers = codec.make_headers(correlation_id=F.lit("äb"), reply_to=F.lit(None).cast("string"))
    assert one(spark, codec.header_get(headers, "correlation-id")) == "äb"
    assert bytes(one(spark, codec.header_bytes(headers, "correlation-id"))) == "äb".encode()
    assert one(spark, codec.header_get(headers, "reply-to")) is None
    assert one(spark, codec.header_error(headers, "reply-to")) == "header 'reply-to' is missing"
    assert one(spark, codec.header_error(headers, "correlation-id")) is None


def test_telemetry_regions(spark, rows):
    regions = {0: "eu", 1: "us", 2: "apac"}
    df = spark.createDataFrame([(f"dev-{i % 4}", regions[i % 3]) for i in range(1, 13)],
                               "device_id string, region string")
    placed = df.withColumn("partition", partitioning.partition_by_region(F.col("region"), 4))
    spread = rows(partitioning.agg_partition_spread(placed, "partition", "region"),
                  "region", "partition", "records")
    assert [(r, n) for r, _, n in spread] == [("apac", 4), ("eu", 4), ("us", 4)]
    at = {r: p for r, p, _ in spread}
    assert at["eu"] == 0 and at["us"] == 1 and at["apac"] in (2, 3)
    audit = partitioning.partition_invariant(placed, "partition", "region")
    assert rows(audit, "single_partition") == [(True,)] * 3


def test_null_key_counts_as_empty(spark, rows):
    df = spark.createDataFrame([(None,), ("",)], "region string")
    placed = rows(df.select(partitioning.partition_by_region(F.col("region"), 4)))
    assert placed[0] == placed[1] and placed[0][0] >= 2


def test_region_partitioner_needs_room():
    with pytest.raises(ValueError):
        partitioning.partition_by_region(None, 2)


def test_invariant_finds_a_key_on_two_partitions(spark, rows):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "key string, partition int")
    assert rows(partitioning.partition_invariant(df, "partition", "key")) == [
        ("a", 2, 2, False), ("b", 1, 1, True)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\0")), min_size=1,
                max_size=20), st.integers(1, 64))
def test_partition_by_key_is_crc32(spark, keys, n):
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = df.select("key", partitioning.partition_by_key(F.col("key"), n)).collect()
    assert all(p == zlib.crc32(k.encode()) % n for k, p in got)
