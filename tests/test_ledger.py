"""The bucketed ledger, the cache in front of it, and commits by manifest."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.operators import outcome
from streamops.streaming.ledger import Ledger, SeenCache, version_of_batch, version_of_round
from streamops.streaming.manifest import Manifest, Part
from streamops.streaming.resilient import ResilientConsumer
from streamops.streaming.sinks import BatchLog, BucketedTable, DeliverySink, LedgerSink

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def ids(spark, *values):
    return spark.createDataFrame([(str(v),) for v in values], "id string")


def known(spark, ledger, version, *values):
    return sorted(r.id for r in ledger.known(spark, version, ids(spark, *values)).collect())


def test_a_ledger_knows_what_older_versions_committed(spark, folder):
    ledger = Ledger(folder("ledger"), bucket_rows=5, fan=3)
    assert known(spark, ledger, version_of_batch(0), 1) == []
    for n in range(11):
        batch = [*range(n * 10, n * 10 + 10), n * 10]
        for _ in range(2):  # a replay
            ledger.commit(spark, version_of_batch(n), ids(spark, *set(batch)))
    assert known(spark, ledger, version_of_batch(11), 0, 55, 109, 110, None) == ["0", "109", "55"]
    assert known(spark, ledger, version_of_batch(5), 49, 50) == ["49"]
    assert sorted(int(r.id) for r in ledger.read(spark).collect()) == list(range(110))
    runs = ledger.runs(spark, version_of_batch(11))
    assert [sum(r.level == k for r in runs) for k in range(3)] == [2, 0, 1]
    assert sum(r.rows for r in runs) == 110 and max(r.depth for r in runs) == 5


def test_a_batch_reads_only_folders_its_ids_hash_to(spark, folder):
    ledger = Ledger(folder("ledger"), bucket_rows=50)
    for n in range(3):
        ledger.commit(spark, version_of_batch(n), ids(spark, *range(n * 4000, n * 4000 + 4000)))
    asked = ids(spark, 5, 99_999)
    plan = ledger.known(spark, version_of_batch(3), asked)
    assert [r.id for r in plan.collect()] == ["5"]
    files = [f for f in plan.inputFiles() if "/run=" in f]
    assert 0 < len(files) <= 2 * 3 * 2 and len({f.split("/bucket=")[1].split("/")[0] for f in files}) <= 2
    # Neither an old ledger nor a new id changes how much is read.
    read = spark.read.parquet(*files).count()
    assert read < 12_000 / 10


def test_small_batches_do_not_shuffle_the_ledger(spark, folder):
    ledger = Ledger(folder("ledger"), bucket_rows=50)
    ledger.commit(spark, version_of_batch(0), ids(spark, *range(4000)))
    found = ledger.known(spark, version_of_batch(1), ids(spark, 1, 2, 3))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("Initial Plan")[0]


def test_rounds_lie_between_batches_and_leftovers_do_not_count(spark, folder):
    ledger = Ledger(folder("ledger"))
    ledger.commit(spark, version_of_batch(0), ids(spark, "a"))
    for number, value in enumerate(("b", "c", "stale")):
        ledger.commit(spark, version_of_round(1, number), ids(spark, value))
    assert known(spark, ledger, version_of_round(1, 0), "a", "b") == ["a"]
    ledger.settle(spark, 1, 2)
    assert known(spark, ledger, version_of_batch(1), "a", "b", "c", "stale") == ["a", "b", "c"]


def marks(spark, *rows):
    return spark.createDataFrame([(i, T0 + timedelta(hours=h)) for i, h in rows], "id string, at timestamp")


def test_the_cache_forgets_after_its_retention(spark, folder):
    cache = SeenCache(folder("cache"), hours=24, fan=2)

    def hits(version, *rows):
        return sorted(r.id for r in cache.known(spark, version, marks(spark, *rows)).collect())

    assert hits(1, ("a", 0)) == []
    for _ in range(2):
        cache.mark(spark, 1, marks(spark, ("a", 0), ("b", 10)))
    cache.mark(spark, 2, marks(spark, ("c", 10.5)))
    assert hits(1, ("a", 1)) == []
    assert hits(3, ("a", 23.9), ("b", 24.5), ("x", 1)) == ["a", "b"]
    assert hits(3, ("a", 24), ("b", 33.9), ("c", 34.6)) == ["b"]
    # Both parts of the tenth hour are one by now; the first hour goes with a later mark.
    assert [(p.level, p.hour % 24) for p in cache.manifest.newest(spark, 3)] == [(0, 0), (1, 10)]
    cache.mark(spark, 3, marks(spark, ("d", 30), ("old", 2)))
    assert sorted(p.hour % 24 for p in cache.manifest.newest(spark, 4)) == [6, 10]
    cache.mark(spark, 4, marks(spark))
    assert hits(5, ("d", 31)) == ["d"]


def test_an_unreachable_cache_falls_through(spark, folder):
    cache = SeenCache(folder("cache"))
    cache.mark(spark, 1, marks(spark, ("a", 0)))
    lost = cache.manifest.newest(spark, 2)
    cache.manifest.commit(spark, 1, [p._replace(path=p.path + "-gone") for p in lost])
    assert cache.known(spark, 2, marks(spark, ("a", 1))).count() == 0 and cache.unreachable == 1


RECORDS = "key string, offset long, value string"


def test_an_id_of_yesterday_passes_the_cache_and_stops_at_the_ledger(spark, folder, rows):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("hour", T.DoubleType())])
    tried = []

    def strategy(attempt):
        tried.append(1)
        return outcome.succeeded()

    consumer = ResilientConsumer(
        folder("out"), schema, "id", strategy, cache=SeenCache(folder("cache")),
        at=F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("hour") * 3600).cast("decimal(18,6)")))

    def batch(*data):
        return spark.createDataFrame([(i, n, f'{{"id": "{i}", "hour": {h}}}') for i, h, n in data], RECORDS)

    consumer.handle(batch(("a", 0, 0), ("b", 1, 1)), 0)
    consumer.handle(batch(("a", 23, 2), ("b", 26, 3), ("c", 26, 4), ("a", 40, 5)), 1)
    consumer.handle(batch(("a", 27, 6), ("b", 28, 7)), 2)
    assert rows(consumer.committed(spark), "id", "offset") == [("a", 0), ("b", 1), ("c", 4)]
    assert rows(consumer.skipped(spark), "id", "offset", "reason", "copies") == [
        ("a", 2, "cache", 2), ("a", 6, "ledger", 1), ("b", 3, "ledger", 1), ("b", 7, "cache", 1)]


def test_a_batch_cut_short_between_its_writes_leaves_nothing_visible(spark, folder, rows):
    schema = T.StructType([T.StructField("id", T.StringType())])
    consumer = ResilientConsumer(folder("out"), schema, "id",
                                 lambda attempt: outcome.failed("poison", "no"))
    data = spark.createDataFrame([("k", n, '{"id": "a"}') for n in range(3)], RECORDS)
    write, calls = consumer._write, []

    def dies(rows_, target, part):
        calls.append(part)
        if part == "copies" and len(calls) == 2:
            raise RuntimeError("killed")
        return write(rows_, target, part)

    consumer._write = dies
    with pytest.raises(RuntimeError):
        consumer.handle(data, 0)
    assert consumer.dead_letters(spark).count() == 0
    consumer.handle(data, 0)
    assert rows(consumer.dead_letters(spark), "offset") == [(0,), (1,), (2,)]


def test_manifests(spark, folder):
    manifest = Manifest(folder("m"), block=2)
    assert manifest.numbers(spark) == [] and manifest.newest(spark, 9) == [] and manifest.parts(spark) == []
    for n in (0, 1, 7, 7):
        manifest.commit(spark, n, [Part("rows", f"p{n}"), Part("rows", f"q{n}")])
    manifest.commit(spark, 8)
    assert manifest.numbers(spark) == [0, 1, 7, 8]
    assert [p.path for p in manifest.newest(spark, 7)] == ["p1", "q1"]
    assert [p.path for p in manifest.newest(spark, 8)] == ["p7", "q7"] and manifest.newest(spark, 9) == []
    assert [p.path for p in manifest.parts(spark, 7)] == ["p0", "p1", "q0", "q1"]


def test_written_but_uncommitted_folders_are_not_read(spark, folder):
    out = BatchLog(folder("out"))
    schema = T.StructType([T.StructField("n", T.LongType())])
    out.commit(spark, 0, out.write(spark.range(3).toDF("n"), 0))
    out.write(spark.range(9).toDF("n"), 1)
    assert out.read(spark, schema).count() == 3
    sink = DeliverySink(folder("deliveries"), "id", F.col("id"))
    assert sink.delivered(spark).count() == 0


def test_only_touched_buckets_are_rewritten(spark, folder, rows):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])

    def add(parts):
        return parts.groupBy("k").agg(F.sum("n").alias("n"))

    table = BucketedTable(folder("table"), schema, "k", add, buckets=8)
    assert table.now(spark).count() == 0

    def put(batch_id, *data):
        return table.put(spark.createDataFrame(list(data), schema), batch_id)

    def files():
        return {f: os.path.getmtime(f.removeprefix("file://")) for f in table.now(spark).inputFiles()}

    assert put(0, *[(k, 1) for k in range(100)]) == list(range(8))
    first = files()
    assert len(put(1, (5, 10), (5, 1))) == 1
    second = files()
    assert len(second) == 8 and len(first.items() & second.items()) == 7
    for _ in range(2):  # a replay reads what was there before it
        put(2, (5, 100), (500, 7))
    got = dict(rows(table.now(spark)))
    assert got == {**{k: 1 for k in range(100)}, 5: 112, 500: 7}
    assert dict(rows(table.before(spark, 1)))[5] == 1 and dict(rows(table.before(spark, 2)))[5] == 12
    some = table.before(spark, 3, spark.createDataFrame([(5,)], "k long"))
    assert len(some.inputFiles()) == 1 and dict(rows(some))[5] == 112
    assert put(3) == [] and table.now(spark).count() == 101


def test_what_the_tiers_are_asked_about_is_read_and_not_computed_again(spark, folder):
    plans = []

    class AskedLedger(Ledger):
        def known(self, spark, version, ids):
            plans.append(ids._jdf.queryExecution().optimizedPlan().toString())
            return super().known(spark, version, ids)

    class AskedCache(SeenCache):
        def known(self, spark, version, rows):
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
            return super().known(spark, version, rows)

    schema = T.StructType([T.StructField("id", T.StringType())])
    consumer = ResilientConsumer(folder("out"), schema, "id", lambda attempt: outcome.succeeded(),
                                 AskedLedger(folder("ids")), AskedCache(folder("cache")))
    sink = LedgerSink(folder("sink"), "key", "offset", "value", ledger=AskedLedger(folder("sink-ids")))
    for n in range(2):
        batch = spark.createDataFrame([(f"k{n}", n, f'{{"id": "{n}"}}')], RECORDS)
        consumer.handle(batch, n)
        sink.commit(batch, n)
    assert len(plans) == 6
    assert not [p for p in plans if "Aggregate" in p or "Join" in p]


def test_the_parts_of_a_hot_hour_are_merged_by_several_tasks(spark, folder):
    cache = SeenCache(folder("cache"), fan=2)
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
                "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for n in range(2):
            cache.mark(spark, n, spark.range(n * 20_000, n * 20_000 + 20_000).select(
                F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit(T0).alias("at")))
    finally:
        for key in settings:
            spark.conf.unset(key)
    [part] = cache.manifest.newest(spark, 2)
    merged = spark.read.parquet(part.path)
    assert part.level == 1 and merged.count() == 40_000 and len(merged.inputFiles()) > 1
