"""Queries that drain a stream over the test tables and return what it left behind.

Each run works in a fresh folder below the session's shared checkpoint folder.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.constants import MICRO_BATCH_RECORDS
from streamops.functions import partitioning as P
from streamops.operators import correlate, enrich, outbox, outcome, saga
from streamops.operators.folds import agg_count_sum
from streamops.operators.windows import agg_tumbling_count
from streamops.plans import tables as t
from streamops.plans.batch import (
    CORRELATION_SQL,
    DELIVERIES_SQL,
    RATES_SQL,
    READ_MODEL_SQL,
    RIDES_PUSH_SQL,
    RIDES_TABLE_SQL,
    RUNNING_PROFILE_SQL,
    SAGA_SQL,
    as_double,
    correlation_columns,
    crc32_sql,
    decoded,
    naive,
    webhooks,
)
from streamops.plans.registry import query
from streamops.schemas import OUTBOX
from streamops.session import new_folder
from streamops.sources import log
from streamops.streaming import sql as stream_sql
from streamops.streaming.ledger import SeenCache
from streamops.streaming.relay import MarkedRelay, Relay, cluster_outbox
from streamops.streaming.resilient import ResilientConsumer
from streamops.streaming.run import (
    drain,
    fan_out as run_fan_out,
    file_sink,
    handler,
    micro_batch,
    record_batches,
)
from streamops.streaming.sinks import (
    BatchLog,
    DeliverySink,
    LedgerSink,
    MaterializedTable,
    ProfileFold,
    ReadModel,
    RetrySink,
)
from streamops.streaming.topology import OUTSIDE, Service, Topology


def _drained(df, root, partition_by=None):
    """Drain a stream into files and read back what was committed."""
    drain(file_sink(df, f"{root}/out", f"{root}/checkpoint", partition_by=partition_by))
    return log.read_committed(df.sparkSession, f"{root}/out", df.schema)


def _handled(df, fn, root, mode="append"):
    """Drain a stream into a micro-batch handler; returns the number of batches."""
    ids = []

    def counted(batch, batch_id):
        fn(batch, batch_id)
        ids.append(batch_id)

    drain(handler(df, counted, f"{root}/checkpoint", mode))
    return max(ids, default=-1) + 1


def _arriving(rows, order, root, parts, start, late=None, **options):
    """Let ``rows`` arrive in ``parts`` appends to a log, by equal ranges of ``order``,
    and after each drain ``start(stream)``, a writer over the log. All but the first
    drain are restarts from the checkpoint. ``late`` rows come with the last part."""
    spark, path = rows.sparkSession, f"{root}/log"
    low, high = rows.agg(F.min(order), F.max(order)).first()
    size = 1 if low is None else -(-(high - low + 1) // parts)
    share = F.coalesce(F.call_function("div", order - F.lit(low), F.lit(size)), F.lit(0))
    for part in range(parts):
        log.log_append(rows.filter(share == part), path)
        if late is not None and part == parts - 1:
            log.log_append(late, path)
        drain(start(log.log_scan(spark, path, rows.schema, **options)))


def _handled_in_parts(rows, order, root, parts, fn):
    """``_arriving`` into a micro-batch handler; returns the number of batches."""
    ids = []

    def counted(batch, batch_id):
        fn(batch, batch_id)
        ids.append(batch_id)

    _arriving(rows, order, root, parts, lambda stream: handler(stream, counted, f"{root}/checkpoint"))
    return max(ids, default=-1) + 1


_RECORDS_PER_FILE = 250_000


def _handled_in_batches(rows, key, root, batches, fn):
    """A log of ``rows``, spread by a hash of ``key``, drained in so many batches or a few
    more, bounded in records; returns their number, which does not grow with the log.

    A batch is a number of files, read by as many tasks. The log is written by one task
    per file and a tenth more, as shares by hash differ in size."""
    spark = rows.sparkSession
    bound = max(1, -(-rows.count() // batches))
    files = min(bound, max(spark.sparkContext.defaultParallelism, -(-bound // _RECORDS_PER_FILE)))
    per_file = -(-bound // files)
    spread = rows.repartition(-(-batches * files * 11 // 10), F.xxhash64(key))
    log.log_append(spread, f"{root}/log", records_per_file=per_file)
    stream = log.log_scan(spark, f"{root}/log", rows.schema, **record_batches(files * per_file, per_file))
    return _handled(stream, fn, root)


# --- windows --------------------------------------------------------------------


_WINDOWS_SQL = """
SELECT event_type AS page, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS views
FROM events GROUP BY 1, 2, 3
"""


def _hourly_views(spark, sf_dir, root, start):
    """Page views in three parts by time. With the last come copies of all views of the
    first week, long after their windows have closed, and a view far ahead, which
    closes every other window."""
    views = t.page_views(spark, sf_dir)
    first, last = views.agg(F.min("at"), F.max("at")).first()
    late = None if first is None else views.filter(
        F.col("at") < F.lit(first) + F.expr("INTERVAL 7 DAYS")).unionByName(spark.createDataFrame(
            [(None, last + timedelta(days=2))], views.schema))

    def counted(stream):
        return start(agg_tumbling_count(stream, size="1 hour", delay="1 hour"))

    _arriving(views, F.unix_micros("at"), root, 3, counted, late)


@query(_WINDOWS_SQL)
def tumbling_stream_append(spark, sf_dir):
    root = new_folder(spark, "tumbling-append")
    _hourly_views(spark, sf_dir, root,
                  lambda counts: file_sink(counts, f"{root}/out", f"{root}/checkpoint"))
    return log.read_committed(spark, f"{root}/out").withColumns(naive("window_start", "window_end"))


@query(_WINDOWS_SQL)
def tumbling_stream_update(spark, sf_dir):
    root = new_folder(spark, "tumbling-update")
    table = MaterializedTable(f"{root}/table", "page", "window_start", "window_end")
    _hourly_views(spark, sf_dir, root,
                  lambda counts: handler(counts, table.put, f"{root}/checkpoint", mode="update"))
    return table.pull(spark).filter(F.col("page").isNotNull()).withColumns(
        naive("window_start", "window_end"))


# --- folds ------------------------------------------------------------------------


@query(RUNNING_PROFILE_SQL)
def profile_stream(spark, sf_dir):
    root = new_folder(spark, "profiles")
    fold = ProfileFold(f"{root}/out", f"{root}/state")
    _handled_in_parts(t.user_events(spark, sf_dir), F.col("offset"), root, 3, fold.derive)
    return spark.read.parquet(fold.out).drop("batch_id")


@query(RIDES_TABLE_SQL)
def materialized_stream(spark, sf_dir):
    root = new_folder(spark, "rides")
    table = MaterializedTable(f"{root}/table", "city")
    rides = t.rides(spark, sf_dir, True, **micro_batch())
    _handled(agg_count_sum(rides), table.put, root, mode="update")
    return table.pull(spark).withColumns(as_double("total_fare"))


@query(READ_MODEL_SQL)
def cdc_read_model_stream(spark, sf_dir):
    root = new_folder(spark, "read-model")
    model = ReadModel(f"{root}/model")
    batches = _handled_in_parts(t.changes(spark, sf_dir), F.col("offset"), root, 3, model.upsert)
    return model.read(spark, batches)


# --- logs -------------------------------------------------------------------------

_EVENTS_SQL = "SELECT event_id, event_type FROM events"
_LOG_SQL = f"""
SELECT event_type AS topic, event_id AS "offset", CAST(user_id AS VARCHAR) AS key,
       CAST({crc32_sql("CAST(user_id AS VARCHAR)")} % 4 AS INTEGER) AS partition,
       CAST(json_extract(value, '$.value') AS DOUBLE) AS value
FROM (SELECT event_type, event_id, user_id, json_object('value', value) AS value FROM events)
"""


def _records(rows):
    value = F.get_json_object("value", "$.value").cast("double")
    return rows.select("topic", "offset", "key", "partition", value.alias("value"))


@query(_EVENTS_SQL)
def log_scan(spark, sf_dir):
    rows = t.source(spark, sf_dir, "events", True).select("event_id", "event_type")
    return _drained(rows, new_folder(spark, "log-scan"))


@query(_EVENTS_SQL)
def bounded_drain(spark, sf_dir):
    rows = t.source(spark, sf_dir, "events", True, **micro_batch()).select(
        "event_id", "event_type"
    )
    return _drained(rows, new_folder(spark, "bounded-drain"))


@query("SELECT event_id, event_type, TRUE AS bounded, TRUE AS several FROM events")
def micro_batches(spark, sf_dir):
    """Batches of a bounded number of records, some ten of them for the whole log: each
    row with whether its batch kept the bound and whether it was one of several."""
    root = new_folder(spark, "micro-batches")
    events = t.table(spark, sf_dir, "events").select("event_id", "event_type")
    bound = max(MICRO_BATCH_RECORDS, -(-events.count() // 10))
    log.log_append(events, f"{root}/log", records_per_file=bound)
    out = BatchLog(f"{root}/out")

    def keep(batch, batch_id):
        out.commit(spark, batch_id, out.write(batch.withColumn("batch", F.lit(batch_id)), batch_id))

    stream = log.log_scan(spark, f"{root}/log", events.schema, **record_batches(bound, bound))
    batches = _handled(stream, keep, root)
    rows = out.read(spark, T.StructType([*events.schema.fields, T.StructField("batch", T.IntegerType())]))
    sizes = rows.groupBy("batch").agg(F.count("*").alias("records"))
    return rows.join(sizes, "batch").select(
        "event_id", "event_type", (F.col("records") <= bound).alias("bounded"), F.lit(batches > 1).alias("several"))


def _event_log(spark, sf_dir):
    events = t.events(spark, sf_dir)
    return log.to_log(events, F.col("event_type"), F.col("user_id"),
                      log.json_value("event_id", "value"), F.col("event_id"), F.col("ts"),
                      partitions=4)


@query(_LOG_SQL)
def log_replay(spark, sf_dir):
    path = new_folder(spark, "log-replay")
    log.log_append(_event_log(spark, sf_dir), path)
    return _records(log.log_replay(spark, path))


@query(_LOG_SQL)
def log_append(spark, sf_dir):
    path = new_folder(spark, "log-append")
    records = _event_log(spark, sf_dir)
    early = F.col("topic").isin("click", "view")
    log.log_append(records.filter(early), path)
    log.log_append(records.filter(~early), path)
    return _records(log.log_replay(spark, path))


@query("""
SELECT 'orders' AS topic, count(*) AS records, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders UNION ALL
SELECT 'events', count(*), CAST(sum(event_id) AS BIGINT) FROM events
""")
def log_scan_multi(spark, sf_dir):
    orders = t.source(spark, sf_dir, "orders", True, **micro_batch()).select(
        F.lit("orders").alias("topic"), F.col("o_orderkey").alias("key")
    )
    events = t.source(spark, sf_dir, "events", True, **micro_batch()).select(
        F.lit("events").alias("topic"), F.col("event_id").alias("key")
    )
    rows = _drained(log.union_topics(orders, events), new_folder(spark, "log-multi"))
    return rows.groupBy("topic").agg(F.count("*").alias("records"), F.sum("key").alias("key_sum"))


@query(_LOG_SQL)
def route_by_column(spark, sf_dir):
    path = new_folder(spark, "routed")
    log.route_by_column(_event_log(spark, sf_dir), path)
    return _records(spark.read.parquet(path))


@query("""
SELECT s AS subscriber, count(*) AS records, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders, (VALUES ('analytics'), ('notifications')) v(s) GROUP BY s
""")
def fan_out(spark, sf_dir):
    orders = t.source(spark, sf_dir, "orders", True, **micro_batch()).select("o_orderkey")
    paths = run_fan_out(orders, new_folder(spark, "fan-out"), ["analytics", "notifications"])
    got = [
        log.read_committed(spark, path, orders.schema).agg(
            F.lit(name).alias("subscriber"), F.count("*").alias("records"),
            F.sum("o_orderkey").alias("key_sum"))
        for name, path in paths.items()
    ]
    return log.union_topics(*got)


@query(f"""
SELECT o_orderkey, CAST({crc32_sql("CAST(o_orderkey AS VARCHAR)")} % 3 AS INTEGER) AS worker FROM orders
""")
def split_work(spark, sf_dir):
    """Three workers, each a query of its own over its share of the log: what they have
    done, job by job."""
    root = new_folder(spark, "split-work")
    jobs = t.source(spark, sf_dir, "orders", True, **micro_batch()).select(
        "o_orderkey", P.partition_by_key(F.col("o_orderkey"), 3).alias("worker"))
    done = [_drained(jobs.filter(F.col("worker") == k), f"{root}/{k}") for k in range(3)]
    return log.union_topics(*done)


# --- transactional enrichment --------------------------------------------------------

_STREAM_PAYMENTS_SQL = f"""
(SELECT o_orderkey AS payment_id, CAST(o_totalprice AS DECIMAL(18,2)) * rate AS usd
 FROM orders JOIN {RATES_SQL}
   ON currency = CASE o_orderpriority WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'EUR'
                 WHEN '3-MEDIUM' THEN 'UAH' END)
"""


@query(f"""
SELECT payment_id, CAST(usd AS DOUBLE) AS amount_usd,
       CASE WHEN usd > 1000 THEN 'HIGH' ELSE 'LOW' END AS risk_level
FROM {_STREAM_PAYMENTS_SQL} p
""")
def exactly_once(spark, sf_dir):
    root = new_folder(spark, "exactly-once")
    for _ in range(2):
        raw = t.payment_stream(spark, sf_dir, **micro_batch())
        done = enrich.enrich_payments(raw, enrich.usd_rates(spark))
        published = outcome.route_outcome(done)["success"].select(
            "payment_id", F.col("amount_usd").cast("double").alias("amount_usd"), "risk_level"
        )
        rows = _drained(published, root)
    return rows


# --- request and reply ------------------------------------------------------------------


@query(CORRELATION_SQL)
def correlation_stream(spark, sf_dir):
    """The log arrives in three parts by time, as rows behind the watermark are dropped;
    a closing time then settles what is pending."""
    root = new_folder(spark, "correlation")
    events = t.events(spark, sf_dir)
    correlate.close_log(spark, f"{root}/closing", None)

    def settled(stream):
        closing = log.log_scan(spark, f"{root}/closing", T.StructType([T.StructField("ts", T.TimestampType())]))
        rows = correlate.settled_stream(t.requests_of(stream), t.replies_of(stream), closing, "10 seconds")
        return file_sink(rows, f"{root}/out", f"{root}/checkpoint")

    _arriving(events, F.unix_micros("ts"), root, 3, settled)
    last = events.agg(F.max("ts")).first()[0]
    if last is not None:
        correlate.close_log(spark, f"{root}/closing", last + timedelta(minutes=1))
        drain(settled(log.log_scan(spark, f"{root}/log", events.schema)))
    return correlation_columns(log.read_committed(spark, f"{root}/out"))


# --- sagas ----------------------------------------------------------------------------

_SAGA_MESSAGE = T.StructType([
    T.StructField("seq", T.IntegerType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("step", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
])


@query(f"SELECT order_id, seq, step, status, reason FROM {SAGA_SQL}")
def saga_stream(spark, sf_dir):
    """A streaming query per service over topic folders; orders come in two parts."""
    services = [
        Service("payment-service", ("orders", "inventory"), (OUTSIDE, "inventory-service"),
                lambda rows: saga.saga_stage(rows, saga.payment_service)),
        Service("inventory-service", ("payments",), ("payment-service",),
                lambda rows: saga.saga_stage(rows, saga.inventory_service)),
    ]
    orders = t.saga_orders(spark, sf_dir)
    even = F.col("o_orderkey") % 2 == 0
    root = new_folder(spark, "saga")
    for part in (orders.filter(even), orders.filter(~even)):
        topology = Topology(spark, root, _SAGA_MESSAGE, services)
        topology.publish(saga.orders_created(part, "o_orderkey", F.col("item")))
        topology.drain(most=10)
    return topology.messages().select("order_id", "seq", "step", "status", "reason")


# --- delivery -------------------------------------------------------------------------


def _delivery_sink(spark, sf_dir):
    root = new_folder(spark, "deliveries")
    sink = DeliverySink(f"{root}/out", "event_id", F.col("props"))
    _handled(webhooks(spark, sf_dir, True, **micro_batch()), sink.deliver, root)
    return sink


@query(f"""
SELECT CAST(d.event_id AS VARCHAR) AS key, props AS value, attempts, error AS reason
FROM ({DELIVERIES_SQL}) d JOIN events e ON d.event_id = e.event_id WHERE outcome <> 'success'
""")
def dead_letters(spark, sf_dir):
    return _delivery_sink(spark, sf_dir).dead_letter_monitor(spark)


@query(f"""
SELECT CAST(d.event_id AS VARCHAR) AS key, props AS value, attempts
FROM ({DELIVERIES_SQL}) d JOIN events e ON d.event_id = e.event_id WHERE outcome = 'success'
""")
def delivered(spark, sf_dir):
    return _delivery_sink(spark, sf_dir).delivered(spark)


@query("""
SELECT event_id, CAST(1 + k % 3 AS INTEGER) AS attempt,
       CASE WHEN event_type = 'error' THEN 'poison' ELSE 'success' END AS outcome
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
""")
def rewind_retry(spark, sf_dir):
    root = new_folder(spark, "retries")
    rows = t.source(spark, sf_dir, "events", True, **micro_batch()).select(
        "event_id", "event_type", "props"
    )

    def strategy(attempt):
        return (
            F.when(attempt <= t.k_of() % 3, outcome.failed("transient", "pool saturated"))
            .when(F.col("event_type") == "error", outcome.failed("poison", "refused"))
            .otherwise(outcome.succeeded())
        )

    sink = RetrySink(f"{root}/out", rows.schema, strategy)
    sink.finish(spark, _handled(rows, sink.handle, root))
    return sink.settled(spark).select("event_id", "attempt", "outcome")


@query("""
SELECT CAST(NULL AS VARCHAR) AS transaction_id, props AS payload FROM events WHERE event_id % 5 = 0
UNION ALL
SELECT CAST(event_id AS VARCHAR), props FROM events WHERE event_id % 5 <> 0
""")
def ledger_without_ids(spark, sf_dir):
    """Every fifth record has lost its id: it is parked, one row each."""
    root = new_folder(spark, "ledger-null")
    kept = F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string"))
    records = t.source(spark, sf_dir, "events", True, **micro_batch()).select(
        kept.alias("id"), "props", F.col("event_id").alias("offset"))
    sink = LedgerSink(f"{root}/ledger", "id", "offset", "props")
    _handled(records, sink.commit, root)
    parked = sink.parked(spark).select(F.lit(None).cast("string").alias("transaction_id"), "payload")
    return sink.read(spark).select("transaction_id", "payload").unionByName(parked)


@query("""
SELECT CAST(event_id AS VARCHAR) AS transaction_id, props AS payload
FROM events WHERE event_type <> 'signup'
""")
def dedup_ledger(spark, sf_dir):
    """Clicks are delivered twice, sign-ups were handled before. The log is drained in
    five batches or more; any may hold a copy first."""
    root = new_folder(spark, "ledger")
    copies = F.when(F.col("event_type") == "click", F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    records = t.table(spark, sf_dir, "events").withColumn("copy", F.explode(copies)).select(
        F.col("event_id").cast("string").alias("id"), "props",
        (F.col("event_id") * 2 + F.col("copy")).alias("offset"))
    seed = t.table(spark, sf_dir, "events").filter("event_type = 'signup'").select(
        F.col("event_id").cast("string").alias("transaction_id")
    )
    sink = LedgerSink(f"{root}/ledger", "id", "offset", "props", seed)
    # By a hash of the offset, so that copies are far apart in the log.
    _handled_in_batches(records, "offset", root, 5, sink.commit)
    return sink.read(spark).select("transaction_id", "payload")


@query("""
SELECT CAST(event_id AS VARCHAR) AS id,
       CASE WHEN event_type IN ('error', 'signup') THEN 'deadletter' ELSE 'committed' END AS branch,
       CASE event_type WHEN 'error' THEN 1 ELSE CAST(1 + k % 3 AS INTEGER) END AS attempts,
       CASE event_type WHEN 'error' THEN 'Failed to deserialize' WHEN 'signup' THEN 'refused' END
           AS reason
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
""")
def resilient_consumer(spark, sf_dir):
    """Clicks come twice, errors are cut short, sign-ups are refused, and every
    record fails ``k`` modulo three times before it is accepted or refused. The log
    is drained in five batches or more, with retries in between; any may hold a copy
    first."""
    root = new_folder(spark, "resilient")
    kind = F.col("event_type")
    copies = F.when(kind == "click", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = log.json_value("event_id", "event_type", "props")
    whole = F.when(kind == "error", F.substring(text, F.lit(1), F.length(text) - 1))
    records = t.table(spark, sf_dir, "events").withColumn("copy", F.explode(copies)).select(
             F.col("event_id").cast("string").alias("key"),
             (F.col("event_id") * 2 + F.col("copy")).alias("offset"),
             whole.when(kind != "error", text).alias("value"))
    schema = T.StructType([T.StructField("event_id", T.LongType()),
                           T.StructField("event_type", T.StringType()),
                           T.StructField("props", T.StringType())])

    def strategy(attempt):
        return (
            F.when(attempt <= t.k_of() % 3, outcome.failed("transient", "ledger unavailable"))
            .when(F.col("event_type") == "signup", outcome.failed("poison", "refused"))
            .otherwise(outcome.succeeded())
        )

    consumer = ResilientConsumer(f"{root}/out", schema, "event_id", strategy,
                                 cache=SeenCache(f"{root}/cache"))
    batches = _handled_in_batches(records, "offset", root, 5, consumer.handle)
    consumer.finish(spark, batches)
    done = consumer.committed(spark).withColumn("branch", F.lit("committed"))
    parked = consumer.dead_letters(spark).withColumn("branch", F.lit("deadletter"))
    return done.unionByName(parked).select(
        F.col("key").alias("id"), "branch", "attempts", "reason"
    )


_AGAIN_HOURS = (0, 23, 49)


@query(f"""
WITH a AS (
  SELECT event_id, t, (t - min(t) OVER ()) // ((max(t) OVER () - min(t) OVER () + 5) // 5) AS part
  FROM (SELECT event_id, epoch_us(ts) + c_hours * 3600000000 AS t
        FROM events, (VALUES {', '.join(f'({k}, {h})' for k, h in enumerate(_AGAIN_HOURS))}) v(c, c_hours))),
b AS (
  SELECT event_id, part, min(t) AS t, count(*) AS copies FROM a GROUP BY event_id, part),
marked AS (
  SELECT *, min(t) OVER w AS first, lag(t) OVER w AS before FROM b
  WINDOW w AS (PARTITION BY event_id ORDER BY part))
SELECT CAST(event_id AS VARCHAR) AS id, make_timestamp(t) AS handled_at, copies,
       CASE WHEN before IS NULL THEN 'committed' ELSE 'skipped' END AS branch,
       CASE WHEN before IS NULL THEN NULL WHEN t - first < 24 * 3600000000 THEN 'cache' ELSE 'ledger'
       END AS tier
FROM marked
""")
def anti_cache(spark, sf_dir):
    """Every event is delivered again 23 and 49 hours later, in five parts: what the
    part before has handled less than a day ago stops at the cache, the rest at the
    ledger. Copies within a part are told apart by their number."""
    root = new_folder(spark, "anti-cache")
    hours = F.array(*[F.lit(h) for h in _AGAIN_HOURS])
    records = t.events(spark, sf_dir).withColumn("hours", F.explode(hours)).select(
        "event_id", (F.unix_micros("ts") + F.col("hours") * 3_600_000_000).alias("at")
    ).select(F.col("event_id").cast("string").alias("key"), F.col("at").alias("offset"),
             log.json_value("event_id", "at").alias("value"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("at", T.LongType())])
    consumer = ResilientConsumer(f"{root}/out", schema, "event_id", lambda attempt: outcome.succeeded(),
                                 cache=SeenCache(f"{root}/cache"), at=F.timestamp_micros("at"))
    _handled_in_parts(records, F.col("offset"), root, 5, consumer.handle)
    done = consumer.committed(spark).withColumns({"branch": F.lit("committed"), "tier": F.col("reason")})
    skipped = consumer.skipped(spark).withColumns({"branch": F.lit("skipped"), "tier": F.col("reason")})
    return done.unionByName(skipped).select("id", F.col("at").alias("handled_at"), "copies", "branch", "tier").withColumns(
        naive("handled_at"))


@query("""
SELECT 'cdc.' || event_type AS topic, CAST(user_id AS VARCHAR) AS key, props AS value,
       event_id AS sequence
FROM events WHERE event_type <> 'error'
""")
def relay_published(spark, sf_dir):
    """The whole outbox, entity by entity, until nothing is pending."""
    never = F.lit(None).cast("string")
    relay = Relay(lambda s: t.outbox(s, sf_dir), new_folder(spark, "relay"), outbox.POLL,
                  decoded(), never, partition_by="entity_id")
    return relay.published(spark, relay.run(spark)).drop("pass_no")


_CUSTOMER_EVENT = T.StructType([
    T.StructField("operation", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("email", T.StringType()),
    T.StructField("version", T.LongType()),
])


def _customer_outbox(spark, sf_dir, path):
    """Customer changes to relay: views are of a type nobody may read, errors are cut
    short, a purchase with a small ``k`` deletes its customer. Stored by sequence, in
    blocks that give every task one of a pass's; returns how many rows a pass takes so
    that some ten passes relay all of them, and how many a block has."""
    deleted = (F.col("event_type") == "purchase") & (t.k_of() < 30)
    rows = t.table(spark, sf_dir, "events").withColumn("operation", F.when(deleted, "Delete").when(
        F.col("event_type") == "signup", "Create").otherwise("Update"))
    body = F.to_json(F.struct(
        F.when(F.col("event_type") == "view", "CustomerViewed").otherwise("CustomerCdcEvent").alias("$type"),
        "operation", F.col("user_id").alias("customer_id"), F.col("props").alias("email"),
        F.col("event_id").alias("version")))
    content = F.when(F.col("event_type") == "error", F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    count = rows.count()
    table = t.outbox(spark, sf_dir).drop("content", "topic", "retry_count").join(
        rows.select(F.col("event_id").alias("sequence"), content.alias("content"),
                    F.when(F.col("event_type") == "purchase", "vip-customers").otherwise("customers")
                    .alias("topic"), F.lit(0).alias("retry_count")), "sequence")
    limit = max(100, -(-count // 8))
    block = max(100, min(-(-limit // spark.sparkContext.defaultParallelism), _RECORDS_PER_FILE))
    cluster_outbox(table.select(*OUTBOX.fieldNames()), path, block)
    return limit, block


def _refused(table, retries):
    """Publishing fails for the row in the middle until it has been tried often enough."""
    middle = table.filter(F.col("topic") == "customers").agg(F.max("sequence")).first()[0]
    refused = (F.col("sequence") == F.lit((middle or 0) // 2)) & (F.col("retry_count") < retries)
    return F.when(refused, "broker unavailable")


def _customer_relays(spark, sf_dir, retries, *policies):
    """A marked relay per policy over one outbox, each run until nothing is pending.
    A policy that keeps no count of retries meets no failure."""
    root = new_folder(spark, "marked-relay")
    limit, block = _customer_outbox(spark, sf_dir, f"{root}/outbox")
    kind = F.get_json_object("content", "$['$type']")
    decoded = (kind == "CustomerCdcEvent") & F.from_json("content", _CUSTOMER_EVENT)["operation"].isNotNull()
    table = spark.read.schema(OUTBOX).parquet(f"{root}/outbox")
    for policy in policies:
        error = _refused(table, retries) if policy.keeps_state else F.lit(None).cast("string")
        relay = MarkedRelay(f"{root}/outbox", f"{root}/{policy.name}", replace(policy, limit=limit), decoded, error, block)
        relay.run(spark)
        yield relay


@query("""
SELECT CASE event_type WHEN 'purchase' THEN 'vip-customers' ELSE 'customers' END AS topic,
       CAST(user_id AS VARCHAR) AS key, event_id AS "offset"
FROM events WHERE event_type NOT IN ('view', 'error')
""")
def relay_paced(spark, sf_dir):
    """The relay as a query of its own that makes a pass whenever its interval is over,
    until nothing is pending; a reader follows its topics."""
    root = new_folder(spark, "paced-relay")
    limit, block = _customer_outbox(spark, sf_dir, f"{root}/outbox")
    kind = F.get_json_object("content", "$['$type']")
    decoded = (kind == "CustomerCdcEvent") & F.from_json("content", _CUSTOMER_EVENT)["operation"].isNotNull()
    relay = MarkedRelay(f"{root}/outbox", f"{root}/relay", replace(outbox.POLL, limit=limit), decoded,
                        F.lit(None).cast("string"), block)
    running = relay.start(spark, f"{root}/checkpoint").start()
    try:
        while not relay.is_done(spark):
            running.awaitTermination(1)
    finally:
        relay.stop(running)
    topics = [relay.topic_log(spark, name, streaming=False).withColumn("topic", F.lit(name))
              for name in ("customers", "vip-customers")]
    return log.union_topics(*topics).select("topic", "key", "offset").distinct()


_STOPPED = """event_id = (SELECT max(event_id) // 2 FROM events WHERE event_type <> 'purchase')
       AND event_type NOT IN ('view', 'error')"""


@query(f"""
SELECT p AS policy, event_id AS sequence,
       CASE WHEN event_type IN ('view', 'error') THEN 'poison' ELSE 'published' END AS action,
       CASE WHEN p = 'poll' THEN 'Pending' WHEN event_type IN ('view', 'error') THEN 'Failed'
            ELSE 'Completed' END AS state,
       CAST(CASE WHEN p <> 'poll' AND {_STOPPED} THEN 2 ELSE 0 END AS INTEGER) AS retry_count,
       CASE WHEN event_type IN ('view', 'error') THEN 'Failed to deserialize' END AS error
FROM events, (VALUES ('poll'), ('batch'), ('state_machine')) v(p)
""")
def relay_policies(spark, sf_dir):
    """The whole outbox through all three policies, oldest rows first; one record is
    refused twice by the broker."""
    relays = _customer_relays(spark, sf_dir, 2, outbox.POLL, outbox.BATCH, outbox.STATE_MACHINE)
    done = [relay.settled(spark).withColumn("policy", F.lit(relay.policy.name)) for relay in relays]
    return log.union_topics(*done).select("policy", "sequence", "action", "state", "retry_count", "error")


@query(f"""
SELECT user_id AS customer_id, arg_max(props, event_id) FILTER (NOT gone) AS email,
       arg_max(gone, event_id) AS is_deleted
FROM (SELECT *, event_type = 'purchase' AND CAST(json_extract(props, '$.k') AS INTEGER) < 30 AS gone
      FROM events WHERE event_type NOT IN ('view', 'error') AND NOT ({_STOPPED}))
GROUP BY user_id HAVING count(*) FILTER (NOT gone) > 0
""")
def outbox_to_read_model(spark, sf_dir):
    """Outbox, relay with a retry budget, topics, and the read model that follows them:
    only records of an allowed type arrive, and not the one the broker refuses for
    good."""
    relay = next(_customer_relays(spark, sf_dir, 3, outbox.STATE_MACHINE))
    root = new_folder(spark, "search-index")
    model = ReadModel(f"{root}/model")

    def changes(topic):
        return relay.topic_log(spark, topic).select(
            "offset", F.from_json("value", _CUSTOMER_EVENT).alias("v")).select("offset", "v.*")

    both = log.union_topics(changes("customers"), changes("vip-customers"))
    return model.read(spark, _handled(both, model.upsert, root))


# --- SQL surface -----------------------------------------------------------------------

_RIDE_JSON = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("ride_id", T.LongType()),
    T.StructField("fare", T.DoubleType()),
])


def _ride_stream(spark, sf_dir, root):
    """A stream view over rides that arrive through two inserts."""
    rides = t.rides(spark, sf_dir)
    small = F.col("fare") < 20
    stream_sql.insert_into_stream(rides.filter(small), f"{root}/log")
    stream_sql.create_stream_view(spark, "ride_requests", f"{root}/log", _RIDE_JSON)
    return rides.filter(~small)


@query(RIDES_PUSH_SQL)
def rides_push_sql(spark, sf_dir):
    root = new_folder(spark, "push")
    rest = _ride_stream(spark, sf_dir, root)
    sql = "SELECT CITY, RIDE_ID, FARE FROM Ride_Requests WHERE fare > 10"
    for _ in range(2):
        writer = stream_sql.push_query(spark, sql, f"{root}/out", f"{root}/checkpoint")
        stream_sql.refresh(writer)
        if rest is not None:
            stream_sql.insert_into_stream(rest, f"{root}/log")
            rest = None
    return log.read_committed(spark, f"{root}/out").toDF("city", "ride_id", "fare")


@query(RIDES_TABLE_SQL)
def rides_table_sql(spark, sf_dir):
    root = new_folder(spark, "ctas")
    rest = _ride_stream(spark, sf_dir, root)
    sql = "SELECT city, count(*) AS rides, sum(CAST(fare AS DECIMAL(18,2))) AS total_fare " \
          "FROM ride_requests GROUP BY city"
    for _ in range(2):
        table, writer = stream_sql.create_table_as_select(
            spark, sql, "city", f"{root}/table", f"{root}/checkpoint"
        )
        stream_sql.refresh(writer)
        if rest is not None:
            stream_sql.insert_into_stream(rest, f"{root}/log")
            rest = None
    return stream_sql.pull_query(spark, table).withColumns(as_double("total_fare"))
