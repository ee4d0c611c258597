"""Folds and running folds, against literal inputs and brute force."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from streamops.operators import folds


def account_events(spark):
    return spark.createDataFrame(
        [(0, "ACC-1", "Opened", D(0)), (1, "ACC-1", "Deposited", D(500)),
         (2, "ACC-2", "Opened", D(0)), (3, "ACC-1", "Withdrawn", D(120)),
         (4, "ACC-2", "Deposited", D(300)), (5, "ACC-1", "Deposited", D(50)),
         (6, "ACC-3", "Opened", D(9))],
        "offset long, account_id string, type string, amount decimal(18,2)")


def user_events(spark, n=10):
    users, actions = ["u-alice", "u-bob", "u-carol"], ["login", "view_item", "add_to_cart",
                                                       "checkout"]
    return spark.createDataFrame(
        [(i, users[i % 3], actions[i % 4], None) for i in range(n)],
        "offset long, user_id string, action string, payload string")


def test_balances_in_key_order(spark):
    got = folds.agg_balance(account_events(spark)).orderBy("account_id").collect()
    assert [tuple(r) for r in got] == [
        ("ACC-1", D("430.00")), ("ACC-2", D("300.00")), ("ACC-3", D("0.00"))]


@pytest.mark.parametrize("chunk", [1, 2, 3, 1000])
def test_running_balance(spark, rows, chunk):
    assert rows(folds.running_balance(account_events(spark), chunk), "offset", "balance") == [
        (0, D("0.00")), (1, D("500.00")), (2, D("0.00")), (3, D("380.00")),
        (4, D("300.00")), (5, D("430.00")), (6, D("0.00"))]


def test_profiles(spark, rows):
    assert rows(folds.agg_profile(user_events(spark))) == [
        ("u-alice", 4, "view_item"), ("u-bob", 3, "checkout"), ("u-carol", 3, "login")]


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_running_profile_gives_one_row_per_event(spark, rows, chunk):
    got = rows(folds.running_profile(user_events(spark), chunk))
    assert len(got) == 10
    assert (9, "u-alice", 4, "view_item") in got and (0, "u-alice", 1, "login") in got


@pytest.mark.parametrize("chunk", [7, 100, 100_000])
def test_running_sum_of_a_hot_key_equals_brute_force(spark, chunk):
    rng = random.Random(5)
    data = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", rng.randrange(-9, 10))
            for i in rng.sample(range(5_000), 2_000)]
    df = spark.createDataFrame(data, "offset long, key string, v long")
    got = folds.running_sum(df, "key", "offset", F.col("v"), "total", chunk)
    sums, expected = {}, {}
    for offset, key, v in sorted(data):
        sums[key] = sums.get(key, 0) + v
        expected[offset] = sums[key]
    assert {r.offset: r.total for r in got.collect()} == expected


def test_running_sum_never_puts_more_than_a_chunk_into_one_group(spark):
    spark.range(10_000).select(
        F.col("id").alias("offset"), F.lit("hot").alias("key")
    ).createOrReplaceTempView("hot_rows")
    df = spark.createDataFrame(spark.table("hot_rows").toPandas())
    out = folds.running_sum(df, "key", "offset", F.lit(1), "n", 100)
    spread = out.groupBy(F.spark_partition_id()).count()
    assert out.agg(F.max("n")).first()[0] == 10_000
    with_aqe_off = {"spark.sql.adaptive.enabled": "false"}
    for key, value in with_aqe_off.items():
        spark.conf.set(key, value)
    try:
        assert spread.count() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("spread", ["even", "crowded"])
def test_only_hot_keys_are_cut_and_into_chunks_of_their_own_rows(spark, spread):
    hot = [n * 10 for n in range(3000)] if spread == "even" else [0, *range(500_000, 502_999)]
    taken = set(hot)
    cold = [(n, f"k{n % 30}") for n in range(1, 1201) if n not in taken]
    df = spark.createDataFrame([(n, "hot") for n in hot] + cold, "offset long, key string")
    placed, found = folds.in_chunks(df, "key", "offset", 100)
    sizes = {(r.key, r._chunk, r._inner): r.n for r in placed.groupBy("key", "_chunk", "_inner")
             .agg(F.count("*").alias("n")).collect()}
    assert found and all((k[1] is None) == (k[0] != "hot") for k in sizes)
    parts = [n for k, n in sizes.items() if k[0] == "hot"]
    assert max(parts) < 200 and len(parts) <= 3000 / 100 * 2 + 2 and sum(parts) == 3000
    assert folds.in_chunks(df, "key", "offset", 3000)[1] is False


def test_running_sum_starts_from_initial_values(spark, rows):
    df = spark.createDataFrame([(1, "a"), (5, "a"), (9, "b")], "offset long, key string")
    start = spark.createDataFrame([("a", 10), ("c", 99)], "key string, n long")
    got = folds.running_sum(df, "key", "offset", F.lit(1), "n", 4, start)
    assert rows(got, "offset", "n") == [(1, 11), (5, 12), (9, 1)]


def test_count_sum(spark, rows):
    rides = spark.createDataFrame(
        [("kyiv", 8.50), ("kyiv", 14.20), ("lviv", 11.00), ("kyiv", 22.75)],
        "city string, fare double")
    assert rows(folds.agg_count_sum(rides)) == [("kyiv", 3, D("45.45")), ("lviv", 1, D("11.00"))]


CHANGES = "offset long, operation string, customer_id int, email string, version long"


def fold(spark, rows, *changes, order="offset"):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(changes)], CHANGES)
    return rows(folds.agg_cdc_fold(df, order))


def test_changes(spark, rows):
    assert fold(spark, rows, ("Create", 1, "vitah@example.com", 1),
                ("Create", 2, "ivan@example.com", 2), ("Update", 1, "vitah.p@example.com", 3),
                ("Delete", 2, None, 4)) == [
        (1, "vitah.p@example.com", False), (2, "ivan@example.com", True)]


def test_delete_before_create_and_of_an_unknown_id(spark, rows):
    assert fold(spark, rows, ("Delete", 1, None, 1), ("Create", 1, "a", 2),
                ("Delete", 2, None, 3)) == [(1, "a", False)]


def test_delete_then_create_clears_the_mark(spark, rows):
    assert fold(spark, rows, ("Create", 1, "a", 1), ("Delete", 1, None, 2),
                ("Update", 1, None, 3)) == [(1, None, False)]


def test_unknown_operation_is_ignored(spark, rows):
    assert fold(spark, rows, ("Create", 1, "a", 1), ("Delete", 1, None, 2),
                ("Merge", 1, "b", 3)) == [(1, "a", True)]


def test_order_by_version(spark, rows):
    late = (("Update", 1, "new", 5), ("Update", 1, "old", 2))
    assert fold(spark, rows, *late) == [(1, "old", False)]
    assert fold(spark, rows, *late, order="version") == [(1, "new", False)]


def test_merging_parts_equals_folding_all(spark, rows):
    rng = random.Random(3)
    data = [(i, rng.choice(["Create", "Update", "Delete", "Merge"]), rng.randrange(15),
             f"e{i}" if rng.random() < 0.9 else None, i) for i in range(300)]
    df = spark.createDataFrame(data, CHANGES)
    parts = [folds.cdc_changes_by_key(df.filter(f"offset % 3 = {n}")) for n in (2, 0, 1)]
    merged = folds.cdc_merge(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert rows(folds.cdc_read_model(merged)) == rows(folds.agg_cdc_fold(df))
    model = {}
    for _, op, cid, email, _ in data:
        if op in ("Create", "Update"):
            model[cid] = (email, False)
        elif op == "Delete" and cid in model:
            model[cid] = (model[cid][0], True)
    assert {r[0]: (r[1], r[2]) for r in folds.agg_cdc_fold(df).collect()} == model


def test_upsert_match(spark, rows):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "id int, email string")
    incoming = spark.createDataFrame([(2, None), (3, "c")], "id int, email string")
    assert rows(folds.upsert_match(current, incoming, "id")) == [(1, "a"), (2, None), (3, "c")]


def test_running_sum_treats_a_null_key_as_a_key(spark, rows):
    df = spark.createDataFrame([(None, i) for i in range(6)] + [("a", 1)], "key string, offset long")
    start = spark.createDataFrame([(None, 10)], "key string, n long")
    got = folds.running_sum(df, "key", "offset", F.lit(1), "n", 2)
    assert rows(got.filter("key is null"), "n") == [(n,) for n in range(1, 7)]
    got = folds.running_sum(df, "key", "offset", F.lit(1), "n", 2, start)
    assert rows(got.filter("key is null"), "offset", "n") == [(i, 11 + i) for i in range(6)]
    assert rows(got.filter("key = 'a'"), "n") == [(1,)]
