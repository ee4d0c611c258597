"""Streams: batch equivalence, restarts, replays, late rows, state."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops import schemas
from streamops.operators import correlate, enrich, folds, outcome, saga
from streamops.operators.windows import agg_tumbling_count
from streamops.plans import streams as plans
from streamops.plans.registry import QUERIES
from streamops.sources import log
from streamops.streaming import sql as stream_sql
from streamops.streaming.run import (
    await_caught_up,
    drain,
    emit_every,
    fan_out,
    file_sink,
    handler,
    LateRows,
    late_rows,
    micro_batch,
    micro_batch_records,
    paced,
    record_batches,
)
from streamops.streaming.resilient import ResilientConsumer
from streamops.streaming.seen import anti_cache
from streamops.streaming.sinks import (
    DeliverySink,
    LedgerSink,
    MaterializedTable,
    ProfileFold,
    ReadModel,
    RetrySink,
)

T0 = datetime(2024, 1, 1, 12, 0, 0, tzinfo=timezone.utc)
USER_EVENTS = "offset long, user_id long, action string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def append(spark, path, schema, *data):
    """One more file at the end of a log."""
    spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema, **options):
    return log.log_scan(spark, path, T._parse_datatype_string(schema), **options)


def user_events(n, seed=7):
    rng = random.Random(seed)
    return [(i, 1 if rng.random() < 0.4 else rng.randrange(2, 9),
             rng.choice(["login", "view_item", "checkout"])) for i in range(n)]


# --- windows -----------------------------------------------------------------

VIEWS = "page string, at timestamp"


def offsets(df):
    start = F.unix_timestamp("window_start") - int(T0.timestamp())
    return sorted(tuple(r) for r in df.select("page", start, "views").collect())


def drain_windows(spark, folder, batches, delay="0 seconds"):
    src, out, checkpoint = folder("src"), folder("out"), folder("cp")
    for seconds in batches:
        append(spark, src, VIEWS, *[("/home", at(s)) for s in seconds])
    views = stream(spark, src, VIEWS, **micro_batch(files=1))
    query = drain(file_sink(agg_tumbling_count(views, delay=delay), out, checkpoint), 120)
    return offsets(spark.read.parquet(out)), late_rows(query)


def test_a_window_is_emitted_once_when_the_watermark_passes_it(spark, folder):
    assert drain_windows(spark, folder, [[0, 1], [4], [12]]) == ([("/home", 0, 3)], 0)


def test_a_row_two_batches_late_is_dropped(spark, folder):
    got, late = drain_windows(spark, folder, [[0, 1], [12], [13], [2], [30]])
    assert got == [("/home", 0, 2), ("/home", 10, 2)] and late == 1


def test_late_rows_are_counted_over_all_batches(spark, folder):
    src, out, checkpoint = folder("src"), folder("out"), folder("cp")
    with LateRows(spark) as late:
        for batches in ([[0, 1], [12], [13], [2]], [[30], [3], [31, 4]]):
            for seconds in batches:
                append(spark, src, VIEWS, *[("/home", at(s)) for s in seconds])
            views = stream(spark, src, VIEWS, **micro_batch(files=1))
            drain(file_sink(agg_tumbling_count(views, delay="0 seconds"), out, checkpoint), 120)
    assert late.total == 3 and list(late.watermarks.values()) == ["2024-01-01T12:00:31.000Z"]


def test_the_delay_keeps_a_window_open(spark, folder):
    got, late = drain_windows(spark, folder, [[0, 1], [12], [13], [2], [60]], "30 seconds")
    assert late == 0 and got == [("/home", 0, 3), ("/home", 10, 2)]


def test_updates_end_in_the_batch_result(spark, folder):
    src, checkpoint = folder("src"), folder("cp")
    table = MaterializedTable(folder("table"), "page", "window_start", "window_end")
    for seconds in ([0, 1], [3, 6], [7, 21]):
        append(spark, src, VIEWS, *[("/docs", at(s)) for s in seconds])
    views = stream(spark, src, VIEWS, **micro_batch(files=1))
    counts = agg_tumbling_count(views, delay="1 hour")
    drain(handler(counts, table.put, checkpoint, mode="update"), 120)
    assert offsets(table.pull(spark)) == offsets(agg_tumbling_count(spark.read.parquet(src)))


def test_open_windows_survive_a_restart(spark, folder):
    src, out, checkpoint = folder("src"), folder("out"), folder("cp")
    for seconds in ([0, 1], [3], [20]):
        append(spark, src, VIEWS, *[("/home", at(s)) for s in seconds])
        views = stream(spark, src, VIEWS)
        drain(file_sink(agg_tumbling_count(views, delay="0 seconds"), out, checkpoint), 120)
    assert offsets(spark.read.parquet(out)) == [("/home", 0, 3)]


# --- folds ----------------------------------------------------------------------


@pytest.mark.parametrize("buckets", [2, 20])
def test_profiles_over_batches_and_restarts(spark, folder, rows, buckets):
    src, checkpoint = folder("src"), folder("cp")
    events = user_events(60)
    fold = ProfileFold(folder("out"), folder("state"), chunk=8, buckets=buckets)
    for half in (events[:30], events[30:]):
        for i in range(0, 30, 6):
            append(spark, src, USER_EVENTS, *half[i:i + 6])
        drain(handler(stream(spark, src, USER_EVENTS, **micro_batch(files=1)), fold.derive, checkpoint),
              120)
    expected = folds.running_profile(spark.createDataFrame(events, USER_EVENTS))
    derived = spark.read.parquet(fold.out)
    assert derived.select("batch_id").distinct().count() == 10
    columns = ("offset", "user_id", "event_count", "last_action")
    assert rows(derived, *columns) == rows(expected, *columns)


def test_a_replayed_batch_changes_nothing(spark, folder, rows):
    first = spark.createDataFrame(user_events(20), USER_EVENTS)
    second = spark.createDataFrame([(20, 1, "login"), (21, 1, "login")], USER_EVENTS)
    fold = ProfileFold(folder("out"), folder("state"))
    fold.derive(first, 0)
    fold.derive(second, 1)
    once = rows(spark.read.parquet(fold.out))
    fold.derive(first, 0)
    fold.derive(second, 1)
    assert rows(spark.read.parquet(fold.out)) == once


CHANGES = "offset long, operation string, customer_id long, email string, version long"


def test_read_model_in_batches(spark, folder, rows):
    rng = random.Random(2)
    data = [(i, rng.choice(["Create", "Update", "Delete", "Other"]), rng.randrange(6), f"e{i}", i)
            for i in range(50)]
    src = folder("src")
    for i in range(0, 50, 10):
        append(spark, src, CHANGES, *data[i:i + 10])
    model, batches = ReadModel(folder("model"), buckets=2), []

    def upsert(batch, batch_id):
        model.upsert(batch, batch_id)
        model.upsert(batch, batch_id)
        batches.append(batch_id)

    changes = stream(spark, src, CHANGES, **micro_batch(files=1))
    drain(handler(changes, upsert, folder("cp")), 120)
    expected = rows(folds.agg_cdc_fold(spark.createDataFrame(data, CHANGES)))
    assert batches == [0, 1, 2, 3, 4]
    assert rows(model.read(spark, 5)) == expected
    assert rows(model.read(spark)) == expected
    early = rows(folds.agg_cdc_fold(spark.createDataFrame(data[:20], CHANGES)))
    assert rows(model.read(spark, 2)) == early


# --- logs -----------------------------------------------------------------------

PAYMENTS = "payment_id string, currency string, amount decimal(18,2)"


def test_fan_out_gives_every_subscriber_every_record(spark, folder):
    src = folder("src")
    append(spark, src, "number string, total decimal(18,2)",
           *[(f"ORD-{i:04d}", D("99.90") * i) for i in range(1, 9)])
    orders = stream(spark, src, "number string, total decimal(18,2)")
    paths = fan_out(orders, folder("root"), ["analytics", "notifications"], 120)
    assert [spark.read.parquet(p).count() for p in paths.values()] == [8, 8]


def test_exactly_once_and_poison_is_stepped_over(spark, folder, rows):
    src, out, checkpoint = folder("src"), folder("out"), folder("cp")

    def run():
        raw = stream(spark, src, PAYMENTS)
        done = outcome.route_outcome(enrich.enrich_payments(raw, enrich.usd_rates(spark)))
        drain(file_sink(done["success"].select("payment_id", "risk_level"), out, checkpoint), 120)
        return rows(log.read_committed(spark, out))

    append(spark, src, PAYMENTS, ("a", "USD", D(1)), ("b", "GBP", D(1)))
    assert run() == [("a", "LOW")] and run() == [("a", "LOW")]
    append(spark, src, PAYMENTS, ("c", "EUR", D(5000)))
    assert run() == [("a", "LOW"), ("c", "HIGH")]


def test_uncommitted_files_are_not_read(spark, folder):
    src, out = folder("src"), folder("out")
    append(spark, src, PAYMENTS, ("a", "USD", D(1)))
    drain(file_sink(stream(spark, src, PAYMENTS), out, folder("cp")), 120)
    spark.createDataFrame([("ghost", "USD", D(1))], PAYMENTS).write.parquet(folder("elsewhere"))
    spark.createDataFrame([("ghost", "USD", D(1))], PAYMENTS).write.mode("append").parquet(
        out + "/stray")
    assert [r.payment_id for r in log.read_committed(spark, out).collect()] == ["a"]


def test_log_round_trip_with_headers(spark, folder, rows):
    events = spark.createDataFrame([(i, f"user{i}", "welcome") for i in range(1, 21)],
                                   "n long, user string, template string")
    records = log.to_log(events, "emails.outgoing", F.col("user"),
                         log.json_value("user", "template"), F.col("n"), F.lit(T0), partitions=4)
    path = folder("log")
    log.log_append(records.filter("offset <= 8"), path)
    log.log_append(records.filter("offset > 8"), path)
    back = log.log_replay(spark, path)
    assert back.schema.fieldNames() == schemas.LOG.fieldNames()
    assert rows(back, "offset", "key") == rows(records, "offset", "key")
    spread = back.groupBy("key").agg(F.count_distinct("partition").alias("n"))
    assert spread.filter("n <> 1").count() == 0
    out = folder("routed")
    log.route_by_column(records, out)
    assert log.read_topic(spark, out, "emails.outgoing").count() == 20


def test_several_topics_in_one_reader(spark, folder, rows):
    paths = [folder("a"), folder("b")]
    for name, path in zip("ab", paths):
        append(spark, path, "topic string, n long", (name, 1), (name, 2))
    schema = T._parse_datatype_string("topic string, n long")
    out = folder("out")
    drain(file_sink(log.log_scan_multi(spark, paths, schema), out, folder("cp")), 120)
    expected = [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert rows(spark.read.parquet(out)) == expected
    assert rows(log.log_scan_multi(spark, paths, schema, streaming=False)) == expected


def test_a_new_reader_starts_from_the_first_record(spark, folder):
    src = folder("src")
    append(spark, src, "n long", (1,))
    for expected in (1, 2):
        out = folder("out")
        drain(file_sink(stream(spark, src, "n long"), out, folder("cp")), 120)
        assert spark.read.parquet(out).count() == expected
        append(spark, src, "n long", (9,))


def test_micro_batches_are_bounded(spark, folder):
    src, sizes = folder("src"), []
    for n in range(3):
        append(spark, src, "n long", *[(i,) for i in range(n + 1)])
    rows_of = stream(spark, src, "n long", **micro_batch(files=1))
    drain(handler(rows_of, lambda batch, n: sizes.append(batch.count()), folder("cp")), 120)
    assert sizes == [1, 2, 3]
    assert micro_batch_records() == {"maxOffsetsPerTrigger": "100"}
    whole = stream(spark, src, "n long", **micro_batch(2**30))
    drain(handler(whole, lambda batch, n: sizes.append(batch.count()), folder("cp")), 120)
    assert sizes == [1, 2, 3, 6]


def test_micro_batches_are_bounded_in_records(spark, folder):
    src, sizes = folder("src"), []
    log.log_append(spark.range(1234, numPartitions=3).toDF("n"), src, records_per_file=50)
    rows_of = stream(spark, src, "n long", **record_batches(records_per_file=50))
    drain(handler(rows_of, lambda batch, n: sizes.append(batch.count()), folder("cp")), 120)
    assert sum(sizes) == 1234 and max(sizes) == 100 and len(sizes) >= 13
    with pytest.raises(ValueError):
        record_batches(10, 11)


def test_the_number_of_batches_follows_neither_rows_nor_partitions(spark, folder):
    batches = []

    def handle(batch, n):
        batches.append((batch.count(), len(batch.inputFiles())))

    rows_of = spark.range(20_000, numPartitions=40).toDF("n").repartition(40, "n")
    count = plans._handled_in_batches(rows_of, "n", folder("root"), 5, handle)
    assert 5 <= count <= 8 and len(batches) == count
    assert sum(n for n, _ in batches) == 20_000 and max(n for n, _ in batches) <= 4000
    assert plans._handled_in_batches(rows_of.filter("n < 0"), "n", folder("root"), 5, handle) <= 1


def test_correlation_of_a_log_whose_ids_are_not_in_order_of_time(spark, folder):
    root = folder("tables")
    spark.range(60).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 20 AS int)) AS ts",
        "id AS user_id", "element_at(array('view', 'click', 'purchase'), cast(id % 3 AS int) + 1) AS event_type",
        "1.0D AS value", "concat('{\"k\": ', id, '}') AS props").write.parquet(f"{root}/events.parquet")
    found = [sorted(map(tuple, QUERIES[name](spark, root).collect()), key=str)
             for name in ("correlation_stream", "correlation")]
    assert len(found[0]) == 60 and found[0] == found[1]


def test_pacing_and_waiting(spark, folder):
    src = folder("src")
    append(spark, src, "n long", (1,))
    writer = paced(file_sink(stream(spark, src, "n long"), folder("out"), folder("cp")),
                   "500 milliseconds")
    query = writer.start()
    query.processAllAvailable()
    with pytest.raises(TimeoutError):
        await_caught_up(query, 1)
    assert not query.isActive
    out = folder("out")
    query = emit_every(file_sink(stream(spark, src, "n long"), out, folder("cp"))).start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(out).count() == 1


def test_a_failing_handler_fails_the_drain_and_the_batch_comes_back(spark, folder):
    src, checkpoint, seen = folder("src"), folder("cp"), []
    append(spark, src, "n long", (1,), (2,))

    def flaky(batch, batch_id):
        seen.append((batch_id, batch.count()))
        if len(seen) == 1:
            raise RuntimeError("sink unavailable")

    with pytest.raises(Exception, match="sink unavailable"):
        drain(handler(stream(spark, src, "n long"), flaky, checkpoint), 120)
    drain(handler(stream(spark, src, "n long"), flaky, checkpoint), 120)
    assert seen == [(0, 2), (0, 2)]


# --- request and reply ---------------------------------------------------------------


def test_correlation_of_streams(spark, folder, rows):
    asked_schema = "correlation_id string, sku string, req_ts timestamp"
    reply_schema = ("correlation_id string, reply_ts timestamp, reply_offset long, "
                    "total decimal(18,2)")
    asked, came = folder("asked"), folder("came")
    append(spark, asked, asked_schema, ("a", "K", at(0)), ("b", "K", at(1)), ("z", "K", at(100)))
    append(spark, came, reply_schema, ("a", at(2), 1, D(1)), ("a", at(1), 2, D(2)),
           ("b", at(7), 3, D(3)), ("x", at(1), 4, D(4)), ("z", at(101), 5, D(5)))
    pairs = correlate.join_correlation_stream(stream(spark, asked, asked_schema),
                                              stream(spark, came, reply_schema))
    out = folder("out")
    drain(file_sink(pairs, out, folder("cp")), 120)
    assert rows(correlate.settle_pairs(spark.read.parquet(out)), "correlation_id", "total",
                "outcome", "error") == [
        ("a", D("2.00"), "success", None),
        ("b", None, "transient", "no reply for K within 5s"), ("z", D("5.00"), "success", None)]


# --- delivery -----------------------------------------------------------------------

HOOKS = "id string, url string"


def test_dead_letters(spark, folder, rows):
    src = folder("src")
    append(spark, src, HOOKS, ("wh-1", "https://ok.example.com/hook"),
           ("wh-2", "https://always-500.example.com/x"), ("wh-3", "https://ok.example.com/hook"))
    sink = DeliverySink(folder("out"), "id", F.col("url"))

    def deliver(batch, batch_id):
        done = outcome.bounded_retry(batch, lambda n: outcome.classify_delivery(F.col("url")))
        sink.deliver(done, batch_id)
        sink.deliver(done, batch_id)

    drain(handler(stream(spark, src, HOOKS), deliver, folder("cp")), 120)
    assert rows(sink.delivered(spark), "key") == [("wh-1",), ("wh-3",)]
    assert rows(sink.dead_letter_monitor(spark)) == [
        ("wh-2", "https://always-500.example.com/x", 3,
         "endpoint returned 500 Internal Server Error")]


def test_a_missing_reason_reads_as_blank(spark, folder, rows):
    sink = DeliverySink(folder("out"), "id", F.col("id"))
    sink.deliver(spark.createDataFrame([("a", "poison", None, 1)],
                                       "id string, outcome string, error string, attempts int"), 0)
    assert rows(sink.dead_letter_monitor(spark), "key", "reason") == [("a", "")]


def test_transient_rows_come_back_until_they_settle(spark, folder, rows):
    src = folder("src")
    schema = "id string, needs int"
    append(spark, src, schema, ("a", 1), ("b", 3))
    append(spark, src, schema, ("c", 2), ("p", 0))

    def strategy(attempt):
        return (
            F.when(F.col("needs") == 0, outcome.failed("poison", "bad"))
            .when(attempt < F.col("needs"), outcome.failed("transient", "busy"))
            .otherwise(outcome.succeeded())
        )

    events = stream(spark, src, schema, **micro_batch(files=1))
    sink = RetrySink(folder("out"), events.schema, strategy)

    def twice(batch, batch_id):
        sink.handle(batch, batch_id)
        sink.handle(batch, batch_id)

    drain(handler(events, twice, folder("cp")), 120)
    assert rows(sink.settled(spark), "id") == [("a",), ("p",)]
    assert rows(sink.waiting(spark, 2), "id", "attempt") == [("b", 2), ("c", 1)]
    assert sink.finish(spark, 2) == 1
    assert sink.finish(spark, 2) == 0
    assert rows(sink.settled(spark), "id", "attempt", "outcome") == [
        ("a", 1, "success"), ("b", 3, "success"), ("c", 2, "success"), ("p", 1, "poison")]
    assert sink.waiting(spark, 2).count() == 0
    # The checkpoint gives the next input the batch id the rounds came before.
    more = spark.createDataFrame([("d", 1), ("e", 5)], schema)
    sink.handle(more, 2)
    with pytest.raises(RuntimeError):
        sink.finish(spark, 3, most=2)
    assert rows(sink.settled(spark).filter("id = 'e'")) == []
    assert sink.finish(spark, 3) == 4
    assert rows(sink.settled(spark), "id", "attempt") == [
        ("a", 1), ("b", 3), ("c", 2), ("d", 1), ("e", 5), ("p", 1)]


COMMANDS = "id string, offset long, payload string"


def test_ledger(spark, folder, rows):
    src, checkpoint = folder("src"), folder("cp")
    append(spark, src, COMMANDS, ("a", 1, "a1"), ("a", 0, "a0"), ("seeded", 2, "s"))
    append(spark, src, COMMANDS, ("a", 3, "a3"), ("b", 4, "b4"))
    seed = spark.createDataFrame([("seeded",)], "transaction_id string")
    sink = LedgerSink(folder("ledger"), "id", "offset", "payload", seed)

    def twice(batch, batch_id):
        sink.commit(batch, batch_id)
        sink.commit(batch, batch_id)

    commands = stream(spark, src, COMMANDS, **micro_batch(files=1))
    drain(handler(commands, twice, checkpoint), 120)
    expected = [("a", "a0"), ("b", "b4")]
    assert rows(sink.read(spark), "transaction_id", "payload") == expected
    append(spark, src, COMMANDS, ("b", 5, "b5"), ("c", 6, "c6"))
    drain(handler(stream(spark, src, COMMANDS, **micro_batch(files=1)), twice, checkpoint), 120)
    assert rows(sink.read(spark), "transaction_id", "payload") == expected + [("c", "c6")]
    assert sink.parked(spark).count() == 0
    append(spark, src, COMMANDS, (None, 7, "n7"), (None, 8, "n8"), ("d", 9, "d9"))
    drain(handler(stream(spark, src, COMMANDS, **micro_batch(files=1)), twice, checkpoint), 120)
    assert rows(sink.parked(spark)) == [("n7", "record has no id"), ("n8", "record has no id")]
    assert ("d", "d9") in rows(sink.read(spark), "transaction_id", "payload")


def test_resilient_consumer(spark, folder, rows):
    src = folder("src")
    schema = "key string, offset long, value string"
    append(spark, src, schema, ("a", 1, '{"id": "a", "needs": 1}'), ("a", 0, '{"id": "a", "needs": 1}'),
           ("b", 2, '{"id": "b", "needs": 3}'), ("x", 3, "{bad"), ("y", 4, '{"needs": 1}'))
    append(spark, src, schema, ("a", 5, '{"id": "a", "needs": 1}'),
           ("b", 6, '{"id": "b", "needs": 1}'), ("p", 8, '{"id": "p", "needs": 0}'),
           ("p", 7, '{"id": "p", "needs": 0}'))
    payload = T._parse_datatype_string("id string, needs int")

    def strategy(attempt):
        return (
            F.when(F.col("needs") == 0, outcome.failed("poison", "refused"))
            .when(attempt < F.col("needs"), outcome.failed("transient", "unavailable"))
            .otherwise(outcome.succeeded())
        )

    consumer = ResilientConsumer(folder("out"), payload, "id", strategy)

    def twice(batch, batch_id):
        consumer.handle(batch, batch_id)
        consumer.handle(batch, batch_id)

    records = stream(spark, src, schema, **micro_batch(files=1))
    drain(handler(records, twice, folder("cp")), 120)
    assert rows(consumer.committed(spark), "id", "offset", "attempts") == [("a", 0, 1)]
    consumer.finish(spark, 2)
    consumer.handle(spark.createDataFrame([('b', 9, '{"id": "b", "needs": 1}'),
                                           ('z', 10, '{"id": "z", "needs": 5}')], schema), 2)
    consumer.finish(spark, 3)
    assert rows(consumer.committed(spark), "id", "offset", "attempts") == [
        ("a", 0, 1), ("b", 2, 3), ("z", 10, 5)]
    assert rows(consumer.dead_letters(spark), "key", "attempts", "reason") == [
        ("p", 1, "refused"), ("p", 1, "refused"), ("x", 1, "Failed to deserialize"),
        ("y", 1, "record has no id")]


def test_stateless_operators_give_the_same_on_a_stream(spark, folder, rows):
    src, out = folder("src"), folder("out")
    schema = "id string, item string"
    append(spark, src, schema, ("ORD-1", "in-stock-item"), ("ORD-2", "rare-item"))
    log_of = saga.saga_choreography(stream(spark, src, schema), "id", F.col("item"))
    drain(file_sink(log_of, out, folder("cp")), 120)
    batch = saga.saga_choreography(spark.read.parquet(src), "id", F.col("item"))
    assert rows(spark.read.parquet(out)) == rows(batch)


def test_a_log_can_be_json(spark, folder, rows):
    path = folder("log")
    data = spark.createDataFrame([("kyiv", "R-1", 8.5)], schemas.RIDE_REQUEST)
    log.log_append(data, path, "json")
    assert rows(log.log_replay(spark, path, schemas.RIDE_REQUEST, "json")) == [
        ("kyiv", "R-1", 8.5)]
    out = folder("out")
    drain(file_sink(log.log_scan(spark, path, schemas.RIDE_REQUEST, "json"), out, folder("cp")),
          120)
    assert rows(spark.read.parquet(out)) == [("kyiv", "R-1", 8.5)]


def test_routing_with_rebalance(spark, folder, rows):
    path = folder("routed")
    data = spark.range(0, 100, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("topic"),
        F.col("id").alias("n"))
    log.route_by_column(data, path, rebalance=True)
    assert log.read_topic(spark, path, "hot").count() == 34
    assert spark.read.parquet(path).count() == 100
    assert len(spark.read.parquet(path).inputFiles()) == 67


SEEN = "id string, offset long, outcome string"


def drain_seen(spark, src, out, checkpoint, hours=24.0):
    events = stream(spark, src, SEEN, **micro_batch(files=1))
    seen = file_sink(anti_cache(events, "id", "offset", hours), out, checkpoint)
    drain(seen, 120, no_data_batches=False)
    return sorted((r.id, r.offset) for r in spark.read.parquet(out).collect())


def test_seen_ids_are_skipped_and_failures_leave_no_mark(spark, folder):
    src, out, checkpoint = folder("src"), folder("out"), folder("cp")
    append(spark, src, SEEN, ("a", 2, "success"), ("a", 1, "transient"), ("a", 3, "success"),
           ("b", 4, "transient"), ("b", 9, "transient"))
    append(spark, src, SEEN, ("a", 5, "success"), ("a", 10, "transient"),
           ("b", 6, "success"), ("c", 0, "success"))
    assert drain_seen(spark, src, out, checkpoint) == [
        ("a", 1), ("a", 2), ("b", 4), ("b", 6), ("b", 9), ("c", 0)]
    append(spark, src, SEEN, ("b", 7, "success"), ("d", 8, "success"))
    assert drain_seen(spark, src, out, checkpoint) == [
        ("a", 1), ("a", 2), ("b", 4), ("b", 6), ("b", 9), ("c", 0), ("d", 8)]


def test_a_mark_ends_with_its_retention(spark, folder):
    src, out, checkpoint = folder("src"), folder("out"), folder("cp")
    append(spark, src, SEEN, ("a", 1, "success"))
    tiny = 0.001 / 3600
    assert drain_seen(spark, src, out, checkpoint, tiny) == [("a", 1)]
    append(spark, src, SEEN, ("a", 2, "success"))
    assert drain_seen(spark, src, out, checkpoint, tiny) == [("a", 1), ("a", 2)]


# --- SQL ------------------------------------------------------------------------------


def test_sql_surface(spark, folder, rows):
    path, pushed, checkpoint = folder("log"), folder("push"), folder("cp")
    table_path, table_cp = folder("table"), folder("table-cp")
    spark.createDataFrame([], "city string").write.text(path)
    stream_sql.create_stream_view(spark, "ride_requests", path, schemas.RIDE_REQUEST)
    sql = "SELECT CITY, count(*) AS RIDES, sum(fare) AS TOTAL_FARE FROM Ride_Requests GROUP BY CITY"
    rides = [("kyiv", "R-1", 8.50), ("kyiv", "R-2", 14.20), ("lviv", "R-3", 11.00),
             ("kyiv", "R-4", 22.75)]
    for ride in rides:
        stream_sql.insert_into_stream(
            spark.createDataFrame([ride], schemas.RIDE_REQUEST), path)
        table, keep = stream_sql.create_table_as_select(spark, sql, "city", table_path, table_cp)
        stream_sql.refresh(keep, 120)
    push = stream_sql.push_query(
        spark, "SELECT ride_id FROM ride_requests WHERE fare > 10", pushed, checkpoint)
    stream_sql.refresh(push, 120)
    assert rows(spark.read.parquet(pushed)) == [("R-2",), ("R-3",), ("R-4",)]
    got = rows(stream_sql.pull_query(spark, table), "city", "rides",
               F.round("total_fare", 2))
    assert got == [("kyiv", 3, 45.45), ("lviv", 1, 11.0)]
    assert rows(stream_sql.pull_query(spark, table, "City = 'lviv'"), "rides") == [(1,)]
