"""Batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamops.constants import HEADER_CORRELATION_ID, MAX_PUBLISH_RETRIES
from streamops.functions import partitioning as P
from streamops.functions.codec import (
    decode_json,
    decode_or_poison,
    decode_polymorphic,
    header_error,
    header_get,
    make_headers,
)
from streamops.functions import text
from streamops.functions.text import log_line, window_label
from streamops.operators import correlate, enrich, folds, outbox, outcome, saga
from streamops.operators.windows import agg_tumbling_count
from streamops.plans import tables as t
from streamops.plans.registry import query


def naive(*columns: str):
    """Timestamps without zone, the type the SQL side has."""
    return {c: F.col(c).cast("timestamp_ntz") for c in columns}


def as_double(*columns: str):
    return {c: F.col(c).cast("double") for c in columns}


# --- windows ----------------------------------------------------------------


@query("""
SELECT event_type AS page,
       time_bucket(INTERVAL 5 MINUTES, ts) AS window_start,
       time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS window_end,
       count(*) AS views
FROM events GROUP BY 1, 2, 3
""")
def tumbling_count(spark, sf_dir):
    counts = agg_tumbling_count(t.page_views(spark, sf_dir), size="5 minutes")
    return counts.withColumns(naive("window_start", "window_end"))


@query("""
SELECT page, '[' || strftime(w, '%H:%M:%S') || '-'
       || strftime(w + INTERVAL 5 MINUTES, '%H:%M:%S') || '] ' || page || ': '
       || CAST(views AS VARCHAR) || ' views' AS label
FROM (SELECT event_type AS page, time_bucket(INTERVAL 5 MINUTES, ts) AS w, count(*) AS views
      FROM events GROUP BY 1, 2)
""")
def window_labels(spark, sf_dir):
    counts = agg_tumbling_count(t.page_views(spark, sf_dir), size="5 minutes")
    label = window_label(F.col("page"), F.col("window_start"), F.col("window_end"), F.col("views"))
    return counts.select("page", label.alias("label"))


# --- folds by key -------------------------------------------------------------

_SIGNED = """CASE event_type WHEN 'purchase' THEN CAST(value AS DECIMAL(18,2))
             WHEN 'error' THEN -CAST(value AS DECIMAL(18,2)) ELSE 0 END"""


@query(f"""
SELECT user_id AS account_id, CAST(sum({_SIGNED}) AS DOUBLE) AS balance
FROM events GROUP BY user_id
""")
def balances(spark, sf_dir):
    return folds.agg_balance(t.account_events(spark, sf_dir)).withColumns(as_double("balance"))


@query(f"""
SELECT event_id AS "offset", user_id AS account_id,
       CAST(sum({_SIGNED}) OVER (PARTITION BY user_id ORDER BY event_id
            ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance
FROM events
""")
def running_balance(spark, sf_dir):
    return folds.running_balance(t.account_events(spark, sf_dir)).select(
        "offset", "account_id", F.col("balance").cast("double").alias("balance")
    )


@query("""
SELECT user_id, count(*) AS event_count, arg_max(event_type, event_id) AS last_action
FROM events GROUP BY user_id
""")
def profiles(spark, sf_dir):
    return folds.agg_profile(t.user_events(spark, sf_dir))


RUNNING_PROFILE_SQL = """
SELECT event_id AS "offset", user_id,
       count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)
           AS event_count,
       event_type AS last_action
FROM events
"""


@query(RUNNING_PROFILE_SQL)
def running_profile(spark, sf_dir):
    return folds.running_profile(t.user_events(spark, sf_dir))


RIDES_TABLE_SQL = """
SELECT event_type AS city, count(*) AS rides,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_fare
FROM events GROUP BY event_type
"""


@query(RIDES_TABLE_SQL)
def rides_table(spark, sf_dir):
    return folds.agg_count_sum(t.rides(spark, sf_dir)).withColumns(as_double("total_fare"))


RIDES_PUSH_SQL = """
SELECT event_type AS city, event_id AS ride_id, value AS fare
FROM events WHERE value > 10
"""


@query(RIDES_PUSH_SQL)
def rides_push(spark, sf_dir):
    return enrich.filter_threshold(t.rides(spark, sf_dir))


READ_MODEL_SQL = """
SELECT user_id AS customer_id,
       arg_max(props, event_id) FILTER (event_type IN ('signup', 'click', 'purchase')) AS email,
       arg_max(event_type, event_id) FILTER (event_type <> 'view') = 'error' AS is_deleted
FROM events GROUP BY user_id
HAVING count(*) FILTER (event_type IN ('signup', 'click', 'purchase')) > 0
"""


@query(READ_MODEL_SQL)
def cdc_read_model(spark, sf_dir):
    return folds.agg_cdc_fold(t.changes(spark, sf_dir))


# Versions run in another order than the offsets, each used once: both numbers are prime.
_BY_VERSION = "(event_id * 1500450271) % 2147483647"


@query(READ_MODEL_SQL.replace("event_id)", f"{_BY_VERSION})"))
def cdc_read_model_by_version(spark, sf_dir):
    changes = t.changes(spark, sf_dir).withColumn("version", F.col("offset") * 1500450271 % 2147483647)
    return folds.agg_cdc_fold(changes, order="version")


@query("""
SELECT event_id AS "offset",
       CASE event_type WHEN 'signup' THEN 'index' WHEN 'click' THEN 'reindex'
            WHEN 'purchase' THEN 'reindex' WHEN 'error' THEN 'drop'
            ELSE 'unknown op' END AS action
FROM events
""")
def cdc_actions(spark, sf_dir):
    op = F.when(F.col("operation") != "Unknown", F.lower(F.substring("operation", 1, 1)))
    return t.changes(spark, sf_dir).select("offset", enrich.cdc_action(op).alias("action"))


@query("""
SELECT event_id AS "offset", 'unknown CDC operation ''Unknown''' AS error
FROM events WHERE event_type = 'view'
""")
def cdc_poison(spark, sf_dir):
    checked = enrich.cdc_validate(t.changes(spark, sf_dir))
    return outcome.route_outcome(checked)["poison"].select("offset", "error")


@query("""
SELECT COALESCE(n.user_id, c.user_id) AS customer_id,
       CASE WHEN n.user_id IS NOT NULL THEN n.email ELSE c.email END AS email
FROM (SELECT user_id, arg_max(props, event_id) AS email FROM events
      WHERE event_type = 'signup' GROUP BY user_id) c
FULL OUTER JOIN
     (SELECT user_id, arg_max(props, event_id) AS email FROM events
      WHERE event_type IN ('click', 'purchase') GROUP BY user_id) n
ON c.user_id = n.user_id
""")
def upsert_customers(spark, sf_dir):
    def latest(operation):
        return t.changes(spark, sf_dir).filter(F.col("operation") == operation).groupBy(
            "customer_id"
        ).agg(F.max_by("email", "offset").alias("email"))

    return folds.upsert_match(latest("Create"), latest("Update"), "customer_id")


# --- lookups and enrichment -----------------------------------------------------

_PAYMENTS = """
(SELECT o_orderkey AS payment_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
        CASE r_name WHEN 'AMERICA' THEN 'USD' WHEN 'EUROPE' THEN 'EUR' WHEN 'ASIA' THEN 'UAH'
             WHEN 'AFRICA' THEN 'XOF' ELSE 'AED' END AS currency
 FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
RATES_SQL = """(VALUES ('USD', CAST(1 AS DECIMAL(18,6))), ('EUR', CAST(1.09 AS DECIMAL(18,6))),
                ('UAH', CAST(0.024 AS DECIMAL(18,6)))) r(currency, rate)"""


@query(f"""
SELECT payment_id, CAST(amount * rate AS DOUBLE) AS amount_usd,
       CASE WHEN amount * rate > 1000 THEN 'HIGH' ELSE 'LOW' END AS risk_level
FROM {_PAYMENTS} p JOIN {RATES_SQL} USING (currency)
""")
def payments_enriched(spark, sf_dir):
    done = enrich.enrich_payments(t.payments(spark, sf_dir), enrich.usd_rates(spark))
    return outcome.route_outcome(done)["success"].select(
        "payment_id", F.col("amount_usd").cast("double").alias("amount_usd"), "risk_level"
    )


@query(f"""
SELECT payment_id, currency, 'no USD rate for currency ''' || currency || '''' AS error
FROM {_PAYMENTS} p WHERE currency NOT IN ('USD', 'EUR', 'UAH')
""")
def payments_poison(spark, sf_dir):
    done = enrich.join_rate_lookup(t.payments(spark, sf_dir), enrich.usd_rates(spark))
    return outcome.route_outcome(done)["poison"].select("payment_id", "currency", "error")


def _price_requests(spark, sf_dir):
    return t.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("sku"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def _prices(spark, sf_dir):
    """Articles above size 10 have a price, the others none."""
    return t.table(spark, sf_dir, "part").filter("p_size > 10").select(
        F.col("p_partkey").alias("sku"), t.money("p_retailprice").alias("unit_price")
    )


@query("""
SELECT l_orderkey AS order_key, l_partkey AS sku, CAST(l_quantity AS INTEGER) AS quantity,
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS INTEGER) AS DOUBLE) AS total
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10
""")
def requests_priced(spark, sf_dir):
    priced = enrich.join_price_lookup(_price_requests(spark, sf_dir), _prices(spark, sf_dir))
    return priced.select("order_key", "sku", "quantity",
                         F.col("total").cast("double").alias("total"))


@query("""
SELECT l_orderkey AS order_key, l_partkey AS sku, 'transient' AS outcome,
       'no price for ' || CAST(l_partkey AS VARCHAR) AS error
FROM lineitem ANTI JOIN (SELECT p_partkey FROM part WHERE p_size > 10) p
     ON l_partkey = p_partkey
""")
def requests_unpriced(spark, sf_dir):
    missing = enrich.unpriced_requests(_price_requests(spark, sf_dir), _prices(spark, sf_dir))
    return missing.select("order_key", "sku", "outcome", "error")


@query("""
SELECT event_id,
       CASE WHEN event_type <> 'view' THEN 'replies.' || event_type END AS reply_to,
       CASE WHEN k >= 20 THEN CAST(event_id AS VARCHAR) END AS correlation_id,
       CASE WHEN event_type = 'view' THEN 'header ''reply-to'' is missing'
            WHEN k < 20 THEN 'header ''correlation-id'' is missing' END AS error
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
""")
def address_check(spark, sf_dir):
    return enrich.address_check(t.addressed_requests(spark, sf_dir)).drop("headers")


@query("""
SELECT event_id, outcome, error, CASE WHEN outcome = 'success' THEN reply_to END AS topic,
       CASE WHEN outcome = 'success' THEN correlation_id END AS reply_id,
       CASE WHEN outcome = 'success' THEN CAST(price * quantity AS DOUBLE) END AS total
FROM (SELECT *, CASE WHEN lost IS NOT NULL THEN 'poison' WHEN price IS NULL THEN 'transient'
                     ELSE 'success' END AS outcome,
             CASE WHEN lost IS NOT NULL THEN lost
                  WHEN price IS NULL THEN 'no price for ' || CAST(k AS VARCHAR) END AS error
      FROM (SELECT event_id, k, 1 + event_id % 5 AS quantity,
                   CASE WHEN event_type <> 'view' THEN 'replies.' || event_type END AS reply_to,
                   CASE WHEN k >= 20 THEN CAST(event_id AS VARCHAR) END AS correlation_id,
                   CASE WHEN event_type = 'view' THEN 'header ''reply-to'' is missing'
                        WHEN k < 20 THEN 'header ''correlation-id'' is missing' END AS lost
            FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)) e
      LEFT JOIN (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS price
                 FROM part WHERE p_size > 10) p ON k = p_partkey)
""")
def pricing_replies(spark, sf_dir):
    asked = t.table(spark, sf_dir, "events").select(
        "event_id", t.k_of().cast("long").alias("sku"),
        (1 + F.col("event_id") % 5).cast("int").alias("quantity"))
    requests = t.addressed_requests(spark, sf_dir).join(asked, "event_id")
    done = enrich.price_replies(requests, _prices(spark, sf_dir))
    reply_id = header_get(F.col("reply_headers"), HEADER_CORRELATION_ID)
    return done.select("event_id", "outcome", "error", "topic", reply_id.alias("reply_id"),
                       F.col("total").cast("double").alias("total"))


# --- correlation ------------------------------------------------------------------

REQUESTS_SQL = """
(SELECT CAST(event_id AS VARCHAR) AS correlation_id, event_type AS sku, ts AS req_ts
 FROM events WHERE event_type <> 'error')
"""
REPLIES_SQL = """
(SELECT CAST(event_id AS VARCHAR) AS correlation_id, event_id * 2 + copy AS reply_offset,
        ts + to_milliseconds(CAST(json_extract(props, '$.k') AS INTEGER) * 80 + copy * 1000)
            AS reply_ts,
        CAST(value AS DECIMAL(18,2)) * (copy + 1) AS total
 FROM events, (VALUES (0), (1)) c(copy)
 WHERE event_type <> 'signup' AND (copy = 0 OR event_type = 'purchase'))
"""
WINNERS_SQL = f"""
(SELECT correlation_id, reply_offset, reply_ts, total FROM (
   SELECT q.correlation_id, reply_offset, reply_ts, total,
          row_number() OVER (PARTITION BY q.correlation_id ORDER BY reply_ts, reply_offset) AS rn
   FROM {REQUESTS_SQL} q JOIN {REPLIES_SQL} r ON q.correlation_id = r.correlation_id
        AND reply_ts BETWEEN req_ts AND req_ts + INTERVAL 5 SECONDS) WHERE rn = 1)
"""
CORRELATION_SQL = f"""
SELECT q.correlation_id, q.sku, CAST(total AS DOUBLE) AS total, reply_ts,
       CASE WHEN reply_ts IS NULL THEN 'transient' ELSE 'success' END AS outcome,
       CASE WHEN reply_ts IS NULL THEN 'no reply for ' || sku || ' within 5s' END AS error
FROM {REQUESTS_SQL} q LEFT JOIN {WINNERS_SQL} w ON q.correlation_id = w.correlation_id
"""


def correlation_columns(df):
    return df.select("correlation_id", "sku", F.col("total").cast("double").alias("total"),
                     F.col("reply_ts").cast("timestamp_ntz").alias("reply_ts"),
                     "outcome", "error")


@query(CORRELATION_SQL)
def correlation(spark, sf_dir):
    return correlation_columns(
        correlate.join_correlation(t.requests(spark, sf_dir), t.replies(spark, sf_dir))
    )


_SHARED_SQL = f"""
(SELECT CAST(CAST(q.correlation_id AS BIGINT) // 3 AS VARCHAR) AS correlation_id, sku, req_ts,
        CAST(q.correlation_id AS BIGINT) AS request FROM {REQUESTS_SQL} q)
"""
_SHARED_REPLIES_SQL = f"""
(SELECT CAST(CAST(r.correlation_id AS BIGINT) // 3 AS VARCHAR) AS correlation_id, reply_offset,
        reply_ts, total FROM {REPLIES_SQL} r)
"""


@query(f"""
SELECT request, correlation_id, CAST(total AS DOUBLE) AS total, reply_ts,
       CASE WHEN reply_ts IS NULL THEN 'transient' ELSE 'success' END AS outcome
FROM (SELECT q.request, q.correlation_id, total, reply_ts,
             row_number() OVER (PARTITION BY q.request ORDER BY reply_ts, reply_offset) AS rn
      FROM {_SHARED_SQL} q LEFT JOIN {_SHARED_REPLIES_SQL} r ON q.correlation_id = r.correlation_id
           AND reply_ts BETWEEN req_ts AND req_ts + INTERVAL 5 SECONDS) WHERE rn = 1
""")
def correlation_shared_ids(spark, sf_dir):
    """Three requests in a row share an id: each gets the first reply in its own time."""
    def shared(df):
        return df.withColumn("correlation_id", F.floor(F.col("correlation_id").cast("long") / 3)
                             .cast("string"))

    requests = t.requests(spark, sf_dir).withColumn("request", F.col("correlation_id").cast("long"))
    found = correlate.join_correlation(shared(requests), shared(t.replies(spark, sf_dir)))
    return found.select("request", "correlation_id", F.col("total").cast("double").alias("total"),
                        F.col("reply_ts").cast("timestamp_ntz").alias("reply_ts"), "outcome")


@query(f"""
SELECT r.correlation_id, r.reply_offset FROM {REPLIES_SQL} r
ANTI JOIN {WINNERS_SQL} w
  ON r.correlation_id = w.correlation_id AND r.reply_offset = w.reply_offset
""")
def unknown_replies(spark, sf_dir):
    dropped = correlate.anti_unknown_reply(t.requests(spark, sf_dir), t.replies(spark, sf_dir))
    return dropped.select("correlation_id", "reply_offset")


# --- texts and numbers -------------------------------------------------------------


@query("""
SELECT account_id, 'account ' || account_id || ': ' || CAST(balance AS VARCHAR) AS line
FROM (SELECT user_id AS account_id, CAST(sum(CASE event_type WHEN 'purchase' THEN v WHEN 'error' THEN -v
                                             ELSE 0 END) AS DECIMAL(18,2)) AS balance
      FROM (SELECT *, CAST(value AS DECIMAL(18,2)) AS v FROM events) GROUP BY user_id)
ORDER BY account_id
""")
def balance_lines(spark, sf_dir):
    """Balances as text in the order of their accounts."""
    lines = F.concat(F.lit("account "), F.col("account_id").cast("string"), F.lit(": "),
                     text.money_text(F.col("balance")))
    return folds.agg_balance(t.account_events(spark, sf_dir)).select(
        "account_id", lines.alias("line")).orderBy("account_id")


@query("""
SELECT event_id, lpad(CAST(event_id AS VARCHAR), greatest(4, length(CAST(event_id AS VARCHAR)))::INTEGER, '0') AS number,
       rpad(event_type, greatest(6, length(event_type))::INTEGER, ' ') AS kind,
       CAST(CASE WHEN c % 10 > 5 OR (c % 10 = 5 AND c // 10 % 2 = 1) THEN c // 10 + 1 ELSE c // 10 END
            AS DOUBLE) / 10 AS rounded,
       epoch_us(ts) // 5000000 * 5000 AS window_ms
FROM (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM events)
""")
def number_texts(spark, sf_dir):
    """Padded texts, a value rounded half to even, and window starts in epoch milliseconds."""
    return t.events(spark, sf_dir).select(
        "event_id", text.zero_padded(F.col("event_id"), 4).alias("number"),
        text.left_aligned(F.col("event_type"), 6).alias("kind"),
        text.round_half_even(t.money("value"), 1).cast("double").alias("rounded"),
        text.window_start_ms(F.col("ts"), 5000).alias("window_ms"))


# --- sagas ------------------------------------------------------------------------

SAGA_SQL = """
(SELECT CAST(o_orderkey AS VARCHAR) AS order_id, seq, step,
        CASE WHEN seq <= 2 THEN CASE WHEN rare THEN 'rare-item' ELSE 'in-stock-item' END
             WHEN step = 'order.completed' THEN 'ok'
             WHEN step = 'inventory.failed' THEN 'failed' ELSE 'refunded' END AS status,
        CASE WHEN seq > 2 AND rare THEN 'out of stock' END AS reason
 FROM (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS rare FROM orders) o
 JOIN (VALUES (1, NULL, 'order.created'), (2, NULL, 'payment.captured'),
              (3, FALSE, 'order.completed'), (3, TRUE, 'inventory.failed'),
              (4, TRUE, 'order.cancelled')) s(seq, only_rare, step)
   ON only_rare IS NULL OR only_rare = rare)
"""


def _saga(spark, sf_dir):
    return saga.saga_choreography(t.saga_orders(spark, sf_dir), "o_orderkey", F.col("item"))


@query(f"SELECT order_id, seq, step, status, reason FROM {SAGA_SQL}")
def saga_log(spark, sf_dir):
    return _saga(spark, sf_dir).select("order_id", "seq", "step", "status", "reason")


_SAGA_FINAL_SQL = f"""
SELECT order_id, step, status, reason FROM {SAGA_SQL}
WHERE step IN ('order.completed', 'order.cancelled')
"""


@query(_SAGA_FINAL_SQL)
def saga_final(spark, sf_dir):
    return saga.agg_saga_final(_saga(spark, sf_dir))


@query(_SAGA_FINAL_SQL)
def saga_audit(spark, sf_dir):
    return saga.agg_saga_final(_saga(spark, sf_dir), order_by="seq")


@query(f"""
SELECT order_id, order_id || ' FINAL: ' || step || ' (' || status
       || COALESCE(', ' || reason, '') || ')' AS line
FROM ({_SAGA_FINAL_SQL})
""")
def saga_lines(spark, sf_dir):
    final = saga.agg_saga_final(_saga(spark, sf_dir))
    line = log_line(*[F.col(c) for c in ("order_id", "step", "status", "reason")])
    return final.select("order_id", line.alias("line"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 'payment.captured' AS step,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'rare-item' ELSE 'in-stock-item' END AS status
FROM orders
""")
def saga_payment_step(spark, sf_dir):
    return saga.saga_step(_saga(spark, sf_dir).filter("step = 'order.created'"),
                          saga.payment_service).drop("reason")


# --- outcomes ----------------------------------------------------------------------


@query("""
SELECT page_id, CASE WHEN ends_with(lower(url), '.html') THEN 'success' ELSE 'poison' END AS outcome,
       CASE WHEN NOT ends_with(lower(url), '.html')
            THEN 'no decoder for this file type' END AS error
FROM pages
""")
def jobs_outcome(spark, sf_dir):
    jobs = t.table(spark, sf_dir, "pages").select("page_id", "url")
    done = outcome.apply_strategy(jobs, outcome.classify_job(F.col("url"), suffix=".html"))
    return done.drop("url")


def delivery_attempt(attempt: int):
    """Errors meet an endpoint that always fails, sign-ups are refused, and half of
    the views get through on the second try."""
    kind = F.col("event_type")
    url = F.when(kind == "error", "https://always-500.example.com/x").otherwise(
        "https://ok.example.com/hook"
    )
    busy = (kind == "view") & (t.k_of() >= 50) & F.lit(attempt < 2)
    return (
        F.when(kind == "signup", outcome.failed("poison", "payload refused"))
        .when(busy, outcome.failed("transient", "endpoint busy"))
        .otherwise(outcome.classify_delivery(url))
    )


def webhooks(spark, sf_dir, stream=False, **options):
    rows = t.source(spark, sf_dir, "events", stream, **options).select(
        "event_id", "event_type", "props"
    )
    return outcome.bounded_retry(rows, delivery_attempt)


DELIVERIES_SQL = """
SELECT event_id,
       CASE event_type WHEN 'error' THEN 'transient' WHEN 'signup' THEN 'poison'
            ELSE 'success' END AS outcome,
       CASE event_type WHEN 'error' THEN 'endpoint returned 500 Internal Server Error'
            WHEN 'signup' THEN 'payload refused' END AS error,
       attempts,
       CAST(CASE attempts WHEN 1 THEN 0 WHEN 2 THEN 200 ELSE 600 END AS BIGINT) AS waited_ms
FROM (SELECT *, CASE WHEN event_type = 'error' THEN 3
                     WHEN event_type = 'view' AND CAST(json_extract(props, '$.k') AS INTEGER) >= 50
                     THEN 2 ELSE 1 END AS attempts FROM events)
"""


@query(DELIVERIES_SQL)
def deliveries(spark, sf_dir):
    return webhooks(spark, sf_dir).select("event_id", "outcome", "error", "attempts", "waited_ms")


# --- decoding ------------------------------------------------------------------------


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def decode_json_props(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select("event_id", "props")
    return decode_json(rows, t.CONTENT_SCHEMA, "props")


@query("""
SELECT event_id, CASE WHEN ok THEN CAST(json_extract(content, '$.k') AS BIGINT) END AS k,
       CASE WHEN ok THEN 'success' ELSE 'poison' END AS outcome,
       CASE WHEN NOT ok THEN 'Failed to deserialize' END AS error
FROM (SELECT *, json_valid(content) AS ok
      FROM (SELECT event_id, CASE WHEN event_type = 'error'
                   THEN substring(props, 1, length(props) - 1) ELSE props END AS content
            FROM events))
""")
def decode_props(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select("event_id", t.content().alias("value"))
    return decode_or_poison(rows, t.CONTENT_SCHEMA).drop("value")


@query("""
SELECT event_id, event_type AS type_name,
       CASE WHEN event_type = 'click' THEN k END AS click_k,
       CASE WHEN event_type = 'purchase' THEN k END AS purchase_k,
       CASE WHEN event_type IN ('click', 'purchase') THEN 'success' ELSE 'poison' END AS outcome
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
""")
def decode_polymorphic_props(spark, sf_dir):
    tagged = F.concat(F.lit('{"$type":"'), "event_type", F.lit('",'),
                      F.expr("substring(props, 2)"))
    rows = t.table(spark, sf_dir, "events").select("event_id", tagged.alias("content"))
    allowed = {"click": t.CONTENT_SCHEMA, "purchase": t.CONTENT_SCHEMA}
    done = decode_polymorphic(rows, allowed)
    return done.select("event_id", "type_name", F.col("click.k").alias("click_k"),
                       F.col("purchase.k").alias("purchase_k"), "outcome")


@query("""
SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind,
       CASE WHEN event_type = 'error' THEN 'header ''event-type'' is missing' END AS error
FROM events
""")
def header_lookup(spark, sf_dir):
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    rows = t.table(spark, sf_dir, "events").select(
        "event_id", make_headers(event_type=kind, user=F.col("user_id").cast("string"))
        .alias("headers")
    )
    h = F.col("headers")
    return rows.select("event_id", header_get(h, "event-type").alias("kind"),
                       header_error(h, "event-type").alias("error"))


# --- partitions ------------------------------------------------------------------------


@query("""
SELECT c_custkey, r_name AS region,
       CASE r_name WHEN 'EUROPE' THEN 0 WHEN 'AMERICA' THEN 1
            ELSE CAST(2 + length(r_name) % 2 AS INTEGER) END AS partition
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def partition_region(spark, sf_dir):
    region = F.col("region")
    assigned = P.partition_by_region(region, 4, {"EUROPE": 0, "AMERICA": 1}, F.length(region))
    return t.customer_regions(spark, sf_dir).withColumn("partition", assigned)


@query("""
SELECT CASE r_name WHEN 'EUROPE' THEN 0 WHEN 'AMERICA' THEN 1
            ELSE CAST(2 + length(r_name) % 2 AS INTEGER) END AS partition,
       r_name AS region, count(*) AS records
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2
""")
def partition_spread(spark, sf_dir):
    region = F.col("region")
    assigned = P.partition_by_region(region, 4, {"EUROPE": 0, "AMERICA": 1}, F.length(region))
    placed = t.customer_regions(spark, sf_dir).withColumn("partition", assigned)
    return P.agg_partition_spread(placed, "partition", "region")


def crc32_sql(text: str) -> str:
    """CRC32 of an ASCII text, bit by bit over its characters."""
    return f"""xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split({text}, '')]),
  lambda acc, c: list_reduce(list_prepend(xor(acc, c), [0::BIGINT for i in range(8)]),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


_PARTITION_SQL = f"""
(SELECT user_id, CAST({crc32_sql("CAST(user_id AS VARCHAR)")} % 8 AS INTEGER) AS partition, records
 FROM (SELECT user_id, count(*) AS records FROM events GROUP BY user_id))
"""


def _keyed_events(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select(
        "user_id", P.partition_by_key(F.col("user_id"), 8).alias("partition")
    )


@query(f"SELECT partition, user_id, records FROM {_PARTITION_SQL} p")
def partition_key(spark, sf_dir):
    return P.agg_partition_spread(_keyed_events(spark, sf_dir), "partition", "user_id")


def _audit(df):
    """Which partition every key is in, beside the audit that it is one only."""
    numbers = df.groupBy("user_id").agg(F.min("partition").alias("partition"))
    return P.partition_invariant(df, "partition", "user_id").join(numbers, "user_id")


@query(f"""
SELECT user_id, partition, CAST(1 AS BIGINT) AS partitions, records, TRUE AS single_partition
FROM {_PARTITION_SQL} p
""")
def partition_audit(spark, sf_dir):
    return _audit(_keyed_events(spark, sf_dir))


@query(f"""
SELECT user_id, partition, CAST(1 AS BIGINT) AS partitions, 2 * records AS records,
       TRUE AS single_partition
FROM {_PARTITION_SQL} p
""")
def derive_same_key(spark, sf_dir):
    child = folds.running_profile(t.user_events(spark, sf_dir)).select(
        "user_id", P.partition_by_key(F.col("user_id"), 8).alias("partition")
    )
    return _audit(_keyed_events(spark, sf_dir).unionByName(child))


# Null keys: every seventh event has lost its user.
_LOST_SQL = "(SELECT *, CASE WHEN event_id % 7 <> 0 THEN user_id END AS u FROM events)"


@query(f"""
SELECT event_id AS "offset", u AS user_id,
       count(*) OVER (PARTITION BY u ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS event_count,
       event_type AS last_action
FROM {_LOST_SQL} e
""")
def running_profile_null_keys(spark, sf_dir):
    """Chunks far shorter than the keys' runs, so that every carry counts."""
    kept = F.when(F.col("offset") % 7 != 0, F.col("user_id"))
    events = t.user_events(spark, sf_dir).withColumn("user_id", kept)
    return folds.running_profile(events, chunk=100)


# --- outbox ----------------------------------------------------------------------------


def publish_error():
    return F.when(F.col("value") > 110, "broker unavailable")


def decoded():
    return F.from_json("content", t.CONTENT_SCHEMA)["k"].isNotNull()


def _relay(spark, sf_dir, policy, partition_by=None):
    rows = outbox.relay_pass(t.outbox(spark, sf_dir), policy, F.col("occurred_on"),
                             publish_error(), decoded(), partition_by)
    return rows


def _relay_columns(rows):
    return rows.select("sequence", "action", F.col("processed_on").isNotNull().alias("stamped"),
                       "state", "retry_count", "error")


def _relay_sql(limit: str, keeps_state: bool, budget: bool, partition: str = "") -> str:
    gave_up = "(action = 'failed' AND retry_count + 1 >= 3)" if budget else "FALSE"
    poison_error = "WHEN action = 'poison' THEN 'Failed to deserialize'"
    state, retries, error = "'Pending'", "retry_count", f"CASE {poison_error} END"
    if keeps_state:
        state = (f"CASE WHEN action = 'published' THEN 'Completed' WHEN action = 'poison' "
                 f"OR {gave_up} THEN 'Failed' ELSE 'Pending' END")
        retries = "CASE WHEN action = 'failed' THEN retry_count + 1 ELSE retry_count END"
        error = f"CASE {poison_error} WHEN action = 'failed' THEN 'broker unavailable' END"
    return f"""
SELECT sequence, action, action IN ('published', 'poison') OR {gave_up} AS stamped,
       {state} AS state, CAST({retries} AS INTEGER) AS retry_count, {error} AS error
FROM (SELECT *, CASE WHEN sequence > stop THEN 'untouched' WHEN sequence = stop THEN 'failed'
                     WHEN poison THEN 'poison' ELSE 'published' END AS action
      FROM (SELECT *, min(CASE WHEN NOT poison AND value > 110 THEN sequence END)
                      OVER ({partition}) AS stop
            FROM (SELECT event_id AS sequence, user_id, value, event_type = 'error' AS poison,
                         CAST(json_extract(props, '$.k') AS INTEGER) % 3 AS retry_count
                  FROM events ORDER BY event_id {limit})))
"""


@query("SELECT event_id AS sequence FROM events ORDER BY event_id LIMIT 50")
def outbox_scan(spark, sf_dir):
    return outbox.outbox_scan(t.outbox(spark, sf_dir)).select("sequence")


@query(_relay_sql("LIMIT 50", False, False))
def outbox_pass_poll(spark, sf_dir):
    return _relay_columns(_relay(spark, sf_dir, outbox.POLL))


@query(_relay_sql("LIMIT 20", True, False))
def outbox_pass_batch(spark, sf_dir):
    return _relay_columns(_relay(spark, sf_dir, outbox.BATCH))


@query(_relay_sql("LIMIT 100", True, True))
def outbox_pass_state(spark, sf_dir):
    return _relay_columns(_relay(spark, sf_dir, outbox.STATE_MACHINE))


@query(_relay_sql("", True, True, "PARTITION BY user_id"))
def outbox_pass_entities(spark, sf_dir):
    return _relay_columns(_relay(spark, sf_dir, outbox.STATE_MACHINE, "entity_id"))


@query(f"""
SELECT count(*) FILTER (action = 'published') AS published, count(*) AS total
FROM ({_relay_sql("LIMIT 20", True, False)})
""")
def relay_report(spark, sf_dir):
    return outbox.agg_relay_report(_relay(spark, sf_dir, outbox.BATCH))


@query(f"""
SELECT e.event_id AS sequence, COALESCE(stamped, FALSE) AS stamped,
       COALESCE(r.state, 'Pending') AS state,
       COALESCE(r.retry_count, CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 3 AS INTEGER))
           AS retry_count, r.error
FROM events e LEFT JOIN ({_relay_sql("LIMIT 100", True, True)}) r ON e.event_id = r.sequence
""")
def outbox_after_pass(spark, sf_dir):
    table = t.outbox(spark, sf_dir)
    after = outbox.apply_pass(table, _relay(spark, sf_dir, outbox.STATE_MACHINE))
    return after.select("sequence", F.col("processed_on").isNotNull().alias("stamped"),
                        "state", "retry_count", "error")


@query(f"""
SELECT event_id AS sequence,
       CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 3 + 1 >= {MAX_PUBLISH_RETRIES}
            THEN 'Failed' ELSE 'Pending' END AS state
FROM events
""")
def outbox_retry_budget(spark, sf_dir):
    return t.outbox(spark, sf_dir).select(
        "sequence", outbox.retry_budget(F.col("retry_count")).alias("state")
    )
