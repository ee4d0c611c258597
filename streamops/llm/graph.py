"""Candidate pairs in buckets, membership filters and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamops.llm.common import stored
from streamops.session import new_folder

FILTER_BITS = 1 << 24


def filter_bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, key: str | Column) -> np.ndarray:
    """A bit for each hash value some key has: 2 MB whatever the number of keys,
    so it may be sent to every task. It only spares work: who passes it still
    meets the exact join. ``key`` is a column's name or a bit number itself."""
    bit = (filter_bit(key) if isinstance(key, str) else key) + 1  # the bitmap functions count from 1
    rows = keys.select(F.bitmap_bucket_number(bit).alias("at"), F.bitmap_bit_position(bit).alias("bit")) \
        .groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for row in rows:
        bits = np.frombuffer(bytes(row.bits), np.uint8)
        at = (row["at"] - 1) * 4096
        out[at:at + len(bits)] |= bits
    return out


def passes(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = np.asarray(at, np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def in_blocks(members: DataFrame, bucket: str, key: str, size: int) -> DataFrame:
    """Members with ``block``: within it (and nowhere else) each pair of chunks of
    a bucket meets once, so no task has more than 2 x ``size`` rows of a bucket
    at a time and no pair is left out. ``side`` tells a block's two chunks apart;
    where both are the same chunk it is 0 throughout."""
    counts = members.groupBy(bucket).agg(F.count("*").alias("_n")).where("_n > 1")
    chunks = F.ceil(F.col("_n") / F.lit(size)).cast("int")
    # The mean chunk has ``size`` rows; hashing spreads them about it.
    rows = members.join(counts, bucket).withColumn("_chunks", chunks) \
        .withColumn("_own", F.pmod(F.hash(key), F.col("_chunks")))
    other = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    return rows.withColumn("_other", other) \
        .withColumn("block", F.struct(F.col(bucket).alias("bucket"),
                                      F.least("_own", "_other").alias("low"),
                                      F.greatest("_own", "_other").alias("high"))) \
        .withColumn("side", F.when(F.col("_own") > F.col("_other"), 1).otherwise(0)) \
        .drop("_n", "_chunks", "_own", "_other")


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str],
                 rows: int = 4096, size: int = 32 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``columns`` (integers): tables of whole groups with
    each row's group number; a table has some ``rows`` or ``size`` bytes, or one group."""
    held: list[pa.RecordBatch] = []
    n = held_bytes = 0

    def split(table: pa.Table, last: bool):
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in columns])
        new = np.concatenate([[0], (np.diff(keys, axis=1) != 0).any(axis=0).astype(np.int64)])
        group = np.cumsum(new)
        cut = len(group) if last else int(np.searchsorted(group, group[-1]))
        return table.slice(0, cut), group[:cut], table.slice(cut)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            held_bytes += batch.nbytes
        if n >= rows or held_bytes >= size:
            done, group, rest = split(pa.Table.from_batches(held).combine_chunks(), False)
            if len(group):
                yield done, group
            held, n, held_bytes = rest.combine_chunks().to_batches(), rest.num_rows, rest.nbytes
            rows, size = max(rows, 2 * n), max(size, 2 * held_bytes)
    if n:
        done, group, _ = split(pa.Table.from_batches(held).combine_chunks(), True)
        yield done, group


def group_pairs(group: np.ndarray, side: np.ndarray, most: int = 1 << 18):
    """All pairs of rows of one group, by distance between the rows and in slices;
    in a block of two chunks only those across."""
    if not len(group):
        return
    two = np.zeros(group[-1] + 1, bool)
    two[group[side > 0]] = True
    sizes = np.bincount(group)
    for step in range(1, int(sizes.max())):
        left = np.flatnonzero(group[step:] == group[:-step])
        right = left + step
        across = ~two[group[left]] | (side[left] != side[right])
        left, right = left[across], right[across]
        for at in range(0, len(left), most):
            yield left[at:at + most], right[at:at + most]


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the given links: each node with its component's
    smallest node. At most as many links as nodes."""
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[:len(left)], flat[len(left):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


# So many links fit one task's memory many times over; above, rounds of joins.
SMALL_GRAPH = 200_000


def _joined(batches):
    """Components of few links by union and find; smaller nodes become roots."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, kind), pa.array([find(n) for n in nodes], kind)],
            names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the
    smallest node reachable.

    Large-star and small-star rounds until nothing changes: each node's links are
    handed on to its smallest neighbour, so the rounds grow with the logarithm of
    the nodes and no node's neighbours are gathered in one place. Every round is
    a table in the shared folder. At most SMALL_GRAPH links are joined in one task
    instead, with the same result.
    """
    spark = links.sparkSession
    kind = links.schema["a"].dataType
    folder = new_folder(spark, "components")
    # u > v throughout.
    edges = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.count() <= SMALL_GRAPH:
        name = kind.simpleString()
        return stored(edges.coalesce(1).mapInArrow(_joined, f"node {name}, component {name}"),
                      "components")
    state, step = None, 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m") \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        nxt.write.parquet(f"{folder}/{step}")
        edges = spark.read.schema(f"u {kind.simpleString()}, v {kind.simpleString()}") \
            .parquet(f"{folder}/{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, step = now, step + 1
    # Stars now: every link leads to its component's smallest node.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
