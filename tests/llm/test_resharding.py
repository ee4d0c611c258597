"""Flows against linear bounds, and shards against their laws."""

import random

import pytest
from pyspark.sql import functions as F

from streamops.llm import resharding


@pytest.mark.parametrize("seed", range(8))
def test_flow_moves_the_fewest_bytes(seed):
    rng = random.Random(seed)
    supply = [rng.choice([0, rng.randint(1, 500)]) for _ in range(rng.randint(1, 8))]
    capacity = resharding.even_capacities(sum(supply), rng.randint(1, 8))
    flow = resharding.min_cost_flow(supply, capacity)
    for i, s in enumerate(supply):
        assert sum(b for (a, _), b in flow.items() if a == i) == s
    for j, c in enumerate(capacity):
        assert sum(b for (_, a), b in flow.items() if a == j) == c
    kept = sum(min(s, c) for s, c in zip(supply, capacity))
    assert sum(b for (i, j), b in flow.items() if i != j) == sum(supply) - kept


def placed(corpus, texts, shards):
    docs = corpus(list(enumerate(texts))).withColumnRenamed("extra", "shard")
    rows, plan, folder = resharding.reshard(docs, F.pmod("doc_id", F.lit(3)).cast("int"), shards)
    slots = resharding.with_slots(rows.select("doc_id", "size", "shard", "block", "place", "old", "text",
                                              "touched"))
    return slots.collect(), plan, folder


def test_shards_are_even_and_slots_gapless(corpus, spark):
    rng = random.Random(3)
    texts = ["é" * rng.randint(0, 60) for _ in range(600)] + [None, "", "same", "same"]
    rows, plan, folder = placed(corpus, texts, 5)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    by_shard = {}
    for r in rows:
        assert r.text == texts[r.doc_id] and r.size == len((r.text or "").encode()) + 8
        by_shard.setdefault(r.shard, []).append(r)
    sizes = [sum(r.size for r in group) for group in by_shard.values()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 4 * (120 + 8)
    for group in by_shard.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    moved = sum(r.size for r in rows if r.old != r.shard)
    assert abs(moved - sum(b for _, _, b in plan.transfers)) <= 10 * 128
    # Only touched blocks were written.
    written = spark.read.parquet(folder)
    assert {r.doc_id for r in written.select("doc_id").collect()} == {r.doc_id for r in rows if r.touched}
    assert any(not r.touched for r in rows)


def test_nothing_to_move_and_no_rows(corpus):
    rows, plan, _ = placed(corpus, ["x", "x", "x"], 3)
    assert not plan.transfers and all(r.old == r.shard for r in rows)
    assert placed(corpus, [], 4)[0] == []
