"""Relay passes: the prefix rule, poison rows, retry budgets, and repeated passes."""

import random
from dataclasses import replace
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from streamops.operators import outbox as ob
from streamops.operators.folds import agg_cdc_fold
from streamops.streaming.relay import MarkedRelay, Relay, cluster_outbox

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)
COLUMNS = ("id string, sequence long, topic string, entity_type string, entity_id string, "
           "content string, occurred_on timestamp, processed_on timestamp, state string, "
           "retry_count int, error string")


def table(spark, *specs):
    """Rows from (sequence, kind, retry count); kind is ok, poison, down or done."""
    data = []
    for seq, kind, retries in specs:
        done = kind == "done"
        data.append((f"m{seq}", seq, "customers", "Customer", f"c{seq % 2}", kind, NOW,
                     NOW if done else None, "Completed" if done else "Pending", retries,
                     "old" if retries else None))
    return spark.createDataFrame(data, COLUMNS)


def run(df, policy, **kw):
    return ob.relay_pass(df, policy, F.lit(NOW), F.when(F.col("content") == "down", "no broker"),
                         F.col("content") != "poison", **kw)


def result(df):
    return [(r.sequence, r.action, r.processed_on is not None, r.state, r.retry_count, r.error)
            for r in df.orderBy("sequence").collect()]


SPECS = [(5, "ok", 0), (1, "done", 0), (2, "ok", 1), (3, "poison", 0), (4, "down", 1),
         (6, "poison", 0)]
BAD = "Failed to deserialize"


def test_poll(spark):
    assert result(run(table(spark, *SPECS), ob.POLL)) == [
        (2, "published", True, "Pending", 1, "old"), (3, "poison", True, "Pending", 0, BAD),
        (4, "failed", False, "Pending", 1, "old"), (5, "untouched", False, "Pending", 0, None),
        (6, "untouched", False, "Pending", 0, None)]


def test_batch(spark, rows):
    done = run(table(spark, *SPECS), ob.BATCH)
    assert result(done) == [
        (2, "published", True, "Completed", 1, None), (3, "poison", True, "Failed", 0, BAD),
        (4, "failed", False, "Pending", 2, "no broker"),
        (5, "untouched", False, "Pending", 0, None), (6, "untouched", False, "Pending", 0, None)]
    assert rows(ob.agg_relay_report(done)) == [(1, 5)]


@pytest.mark.parametrize("retries,stamped,state", [(0, False, "Pending"), (1, False, "Pending"),
                                                   (2, True, "Failed"), (5, True, "Failed")])
def test_state_machine_gives_up_on_the_third_failure(spark, retries, stamped, state):
    done = run(table(spark, (1, "down", retries), (2, "ok", 0)), ob.STATE_MACHINE)
    assert result(done) == [
        (1, "failed", stamped, state, retries + 1, "no broker"),
        (2, "untouched", False, "Pending", 0, None)]


def test_batch_relay_never_gives_up(spark):
    done = run(table(spark, (1, "down", 7)), ob.BATCH)
    assert result(done) == [(1, "failed", False, "Pending", 8, "no broker")]


@pytest.mark.parametrize("policy,size", [(ob.POLL, 50), (ob.BATCH, 20), (ob.STATE_MACHINE, 100)])
def test_a_pass_takes_the_oldest_rows(spark, policy, size):
    df = table(spark, *[(n, "ok", 0) for n in range(130, 0, -1)])
    assert [r[0] for r in result(run(df, policy))] == list(range(1, size + 1))


def test_top_n_is_not_a_full_sort(spark):
    plan = run(table(spark, *SPECS), ob.POLL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_selection_by_stamp_and_by_state(spark):
    df = spark.createDataFrame(
        [("a", 1, "t", "C", "c", "ok", NOW, None, "Failed", 0, None),
         ("b", 2, "t", "C", "c", "ok", NOW, NOW, "Pending", 0, None)], COLUMNS)
    assert [r[0] for r in result(run(df, ob.POLL))] == [1]
    assert [r[0] for r in result(run(df, ob.STATE_MACHINE))] == [2]


def test_entities_stop_on_their_own(spark):
    df = table(spark, (1, "down", 0), (2, "ok", 0), (3, "ok", 0), (4, "poison", 0), (6, "down", 0),
               (8, "ok", 0))
    assert [r[:2] for r in result(run(df, ob.STATE_MACHINE, partition_by="entity_id"))] == [
        (1, "failed"), (2, "published"), (3, "untouched"), (4, "poison"), (6, "failed"),
        (8, "untouched")]


def test_apply_pass_changes_settled_rows_only(spark):
    df = table(spark, *SPECS)
    after = ob.apply_pass(df, run(df, ob.STATE_MACHINE))
    assert after.columns == df.columns and after.count() == df.count()
    state = {r.sequence: (r.state, r.retry_count, r.error) for r in after.collect()}
    assert state == {1: ("Completed", 0, None), 2: ("Completed", 1, None),
                     3: ("Failed", 0, BAD), 4: ("Pending", 2, "no broker"),
                     5: ("Pending", 0, None), 6: ("Pending", 0, None)}


def test_repeated_passes_settle_everything(spark, folder):
    """The failing row is retried until its budget is used up, then the rest follows."""
    df = table(spark, *SPECS)
    relay = Relay(lambda s: df, folder("relay"), ob.STATE_MACHINE,
                  F.col("content") != "poison", F.when(F.col("content") == "down", "no broker"))
    for number in range(3):
        relay.run_pass(spark, number)
    state = {r.sequence: r.state for r in relay.current(spark, 3).collect()}
    assert state == {1: "Completed", 2: "Completed", 3: "Failed", 4: "Failed", 5: "Completed",
                     6: "Failed"}
    sent = relay.published(spark, 3)
    assert [r.sequence for r in sent.orderBy("sequence").collect()] == [2, 5]
    before = sorted(map(str, relay.current(spark, 3).drop("processed_on").collect()))
    relay.run_pass(spark, 2)
    after = sorted(map(str, relay.current(spark, 3).drop("processed_on").collect()))
    assert before == after and relay.published(spark, 3).count() == 2


def test_outbox_to_read_model(spark, rows, folder):
    mails = [(n, "Create", n, f"customer{n}@example.com") for n in range(1, 6)]
    mails.append((6, "Update", 1, "customer1.updated@example.com"))
    df = spark.createDataFrame(
        [(str(s), s, "customers", "Customer", str(c),
          f'{{"operation":"{op}","customer_id":{c},"email":"{mail}"}}', NOW, None, "Pending", 0,
          None) for s, op, c, mail in mails], COLUMNS)
    schema = "operation string, customer_id int, email string"
    relay = Relay(lambda s: df, folder("relay"), ob.POLL,
                  F.from_json("content", schema)["operation"].isNotNull(),
                  F.lit(None).cast("string"))
    relay.run_pass(spark, 0)
    sent = relay.published(spark, 1)
    changes = sent.select(F.col("sequence").alias("offset"),
                          F.from_json("value", schema).alias("v")).select("offset", "v.*")
    assert rows(agg_cdc_fold(changes)) == [
        (1, "customer1.updated@example.com", False),
        *[(n, f"customer{n}@example.com", False) for n in range(2, 6)]]


def test_relay_runs_at_its_pace(spark, folder):
    df = table(spark, (1, "ok", 0))
    relay = Relay(lambda s: df, folder("relay"), ob.POLL, F.lit(True), F.lit(None).cast("string"))
    query = relay.start(spark, folder("checkpoint")).start()
    try:
        query.processAllAvailable()
        assert relay.published(spark, 1).count() == 1
    finally:
        query.stop()
    assert [p.interval for p in (ob.POLL, ob.BATCH, ob.STATE_MACHINE)] == [
        "500 milliseconds", "5 seconds", "2 seconds"]


def marked(spark, folder, policy, *specs, block=4, down=lambda: F.when(F.col("content") == "down", "no broker")):
    path = folder("outbox")
    cluster_outbox(table(spark, *specs), path, block)
    return MarkedRelay(path, folder("relay"), policy, F.col("content") != "poison", down(), block)


def test_a_marked_relay_equals_one_that_lays_over_all_changes(spark, folder, rows):
    rng = random.Random(4)
    specs = [(n, rng.choice(["ok"] * 5 + ["poison", "down"]), 0) for n in rng.sample(range(1, 200), 60)]
    policy = replace(ob.STATE_MACHINE, limit=7)
    relay = marked(spark, folder, policy, *specs)
    plain = Relay(lambda s: table(spark, *specs), folder("plain"), policy, F.col("content") != "poison",
                  F.when(F.col("content") == "down", "no broker"))
    columns = ("sequence", "action", "state", "retry_count", "error")
    marks = []
    for number in range(6):
        for _ in range(2):  # a pass that is repeated
            relay.run_pass(spark, number)
        plain.run_pass(spark, number)
        marks.append(relay._mark(spark, number + 1)[0])
    assert marks == sorted(marks) and marks[0] < marks[-1]
    changed = plain._changes(spark, 6).join(plain.outbox(spark).select("id", "sequence"), "id")
    assert rows(relay.settled(spark), *columns) == rows(changed, *columns)
    relay.run(spark, 6)
    done = relay.settled(spark)
    assert done.count() == 60 and done.filter("processed_on IS NULL").count() == 0
    sent = sorted(n for n, kind, _ in specs if kind == "ok")
    assert [r.sequence for r in relay.published(spark).orderBy("sequence").collect()] == sent
    topic = relay.published(spark).first().topic
    assert [r.offset for r in relay.topic_log(spark, topic, False).orderBy("offset").collect()] == sent


def test_a_pass_opens_the_folders_of_its_rows_only(spark, folder):
    relay = marked(spark, folder, replace(ob.POLL, limit=4), *[(n, "ok", 0) for n in range(400)])
    for number in range(3):
        assert relay.run_pass(spark, number) == 4
    low = relay._mark(spark, 3)[0]
    read = relay._range(spark, low)
    opened = {r[0].split("block=")[1].split("/")[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert low == 12 and opened == {"3", "4"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "block" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(sequence,12)" in plan and "LessThan(sequence,20)" in plan


def test_a_relay_without_a_retry_limit_waits_at_a_row_that_fails(spark, folder):
    relay = marked(spark, folder, replace(ob.BATCH, limit=3), (1, "ok", 0), (2, "ok", 0), (30, "poison", 0),
                   (31, "down", 0), (90, "ok", 0))
    assert relay.run(spark) == 2
    settled = {r.sequence: (r.action, r.retry_count) for r in relay.settled(spark).collect()}
    assert settled == {1: ("published", 0), 2: ("published", 0), 30: ("poison", 0), 31: ("failed", 1)}
    relay.publish_error = F.lit(None).cast("string")
    relay.run(spark, 2)
    assert [r.sequence for r in relay.published(spark).orderBy("sequence").collect()] == [1, 2, 31, 90]
    assert relay.report["total"] == 0 and relay.report["top"] is None


def test_a_pass_reports_what_its_own_write_has_seen(spark, folder):
    relay = marked(spark, folder, replace(ob.BATCH, limit=5), (1, "ok", 0), (2, "poison", 0), (3, "ok", 0),
                   (4, "down", 0), (5, "ok", 0), (6, "ok", 0))
    assert relay.run_pass(spark, 0) == 3
    assert relay.report == {"published": 2, "total": 5, "stamped": 3, "top": 4, "stuck": 4}
    rows = run(table(spark, (1, "ok", 0), (2, "poison", 0), (3, "ok", 0), (4, "down", 0), (5, "ok", 0)),
               replace(ob.BATCH, limit=5))
    assert tuple(ob.agg_relay_report(rows).first()) == (2, 5)


def test_a_marked_relay_of_an_empty_outbox(spark, folder):
    relay = marked(spark, folder, ob.POLL)
    assert relay.run(spark) == 1 and relay.settled(spark).count() == 0 and relay.published(spark).count() == 0


def test_rows_of_one_sequence_number_go_with_one_pass(spark, folder):
    relay = marked(spark, folder, replace(ob.POLL, limit=2),
                   *[(n, "ok", 0) for n in (1, 2, 2, 2, 7, 300, 301)])
    assert [relay.run_pass(spark, n) for n in range(4)] == [4, 2, 1, 0]
    assert relay.topic_log(spark, "customers", False).count() == 7


def test_a_pass_leaves_its_rows_in_their_tasks_and_publishes_each_once(spark, folder):
    calls = spark.sparkContext.accumulator(0)

    def publish(content):
        calls.add(1)
        return "no broker" if content == "down" else None

    relay = marked(spark, folder, replace(ob.POLL, limit=80),
                   *[(n, "down" if n == 70 else "ok", 0) for n in range(160)],
                   down=lambda: F.udf(publish)("content"))
    files = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        assert relay.run_pass(spark, 0) == 70 and calls.value == 80
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", files)
    assert relay._mark(spark, 1)[0] == 70 and len(spark.read.parquet(f"{relay.passes}/batch_id=0").inputFiles()) > 1
