"""Near-duplicate embeddings by iterative quantisation and multi-index hashing.

Rotations are learned on centred vectors so that signs lose as little as possible
(each start gives its own code). Codes are signs about the origin, as the cosine
is: about the mean, a pair at the threshold could stand at any angle. They are cut into
substrings, one table each; vectors that share a substring and are close in
Hamming distance over the whole code are candidates, and cosines of the original
vectors decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamops.llm.common import stored
from streamops.llm.graph import components, forest, group_pairs, in_blocks, whole_groups

THRESHOLD = 0.95
# The rotations are fitted on at most this many vectors, chosen by hash.
SAMPLE, STARTS_ITERATIONS = 8000, 30
# A pair at the threshold shares no table with at most this probability, if its
# signs differ as those of a random rotation do.
MISSED = 1e-4
# Standard deviations by which a pair at the threshold may differ in more of the
# code than expected. It only spares cosines, which decide: so it is wide.
SLACK = 7
BLOCK = 256


class Codes:
    """Rotations, and the substrings (``tables`` of ``bits``) cut from their signs."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float = THRESHOLD, seed: int = 3):
        self.dim = sample.shape[1]
        # About eight vectors of unrelated data share a bucket, whatever n is.
        self.bits = int(min(24, max(8, round(math.log2(max(2, n))) - 3)))
        differ = math.acos(threshold) / math.pi
        alike = (1 - differ) ** self.bits
        self.tables = math.ceil(math.log(MISSED) / math.log(1 - alike))
        total = self.bits * self.tables
        self.most = int(total * differ + SLACK * math.sqrt(total * differ * (1 - differ)))
        mean = sample.mean(axis=0) if len(sample) else np.zeros(self.dim)
        rng = np.random.default_rng(seed)
        turns = [self._rotation(sample - mean, rng)
                 for _ in range(math.ceil(total / self.dim))]
        self.turn = np.concatenate(turns, axis=1)[:, :total]

    @staticmethod
    def _rotation(x: np.ndarray, rng) -> np.ndarray:
        """One learned rotation: signs and rotation fitted to each other in turns."""
        turn = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(STARTS_ITERATIONS if len(x) else 0):
            signs = np.sign(x @ turn)
            u, _, v = np.linalg.svd(x.T @ signs)
            turn = u @ v
        return turn

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """n x tables substrings."""
        signs = (vectors @ self.turn > 0).reshape(len(vectors), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))


def fit(nodes: DataFrame, sample: int = SAMPLE) -> dict[int, Codes]:
    """Codes for each length of vectors that two or more have: vectors of
    different lengths never link."""
    length = F.length("vector")
    counts = nodes.groupBy(length.alias("bytes")).agg(F.count("*").alias("n")).where("n > 1").collect()
    out = {}
    for size, n in sorted((r["bytes"], r["n"]) for r in counts):
        rows = nodes.where(length == size).select("key", "vector") \
            .orderBy(F.xxhash64("key"), "key").limit(sample).collect()
        out[size // 8] = Codes(np.stack([np.frombuffer(bytes(r.vector)) for r in rows]), n)
    return out


def _units(batches):
    """Valid vectors scaled to length one, in double precision."""
    for batch in batches:
        lists = batch.column("embedding").cast(pa.list_(pa.float64())).to_pylist()
        out = []
        for row in lists:
            unit = None
            if row and None not in row:
                v = np.array(row, np.float64)
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    v = v / top  # no overflow or underflow in the squares
                    unit = (v / np.sqrt((v * v).sum())).tobytes()
            out.append(unit)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "vector"])


def _padded(data: list[bytes], dim: int) -> np.ndarray:
    """As rows of ``dim`` numbers, shorter ones filled up with zeros."""
    out = np.zeros((len(data), dim))
    for i, raw in enumerate(data):
        v = np.frombuffer(raw)
        out[i, :len(v)] = v
    return out


def _blocks(members: DataFrame) -> DataFrame:
    return members.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")


def _first_meetings(rows: pa.Table, group: np.ndarray, codes: np.ndarray, most: np.ndarray):
    """Pairs of a block close in Hamming distance, in the first table they share
    only: a pair is counted once however many tables bring it up."""
    side = rows.column("side").to_numpy()
    table = rows.column("table").to_numpy()
    for left, right in group_pairs(group, side, 1 << 14):
        differ = codes[left] ^ codes[right]
        first = (differ == 0).argmax(axis=1) == table[left]
        left, right, differ = left[first], right[first], differ[first]
        near = np.bitwise_count(differ.astype(np.uint32)).sum(axis=1, dtype=np.int64) <= most[left]
        yield left[near], right[near]


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id): a row per row of ``embeddings``.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; vectors of different lengths do not link. Equal vectors are one
    node and count by their rows, so copies cost nothing. A large bucket is met in
    blocks of bounded size; links are counted where they are found, and only a
    spanning forest of each block leaves its task, never all its pairs.
    """
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    units = stored(embeddings.select("vec_id", "embedding")
                   .mapInArrow(_units, f"vec_id {kind}, vector binary")
                   .withColumn("key", F.unhex(F.md5("vector"))), "unit-vectors")
    nodes = stored(units.where("vector is not null").groupBy("key").agg(
        F.first("vector").alias("vector"), F.count("*").alias("rows")), "vector-nodes")
    fitted = fit(nodes)
    limits = np.array([c.most for c in fitted.values()], np.int64)

    def index(batches):
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            sizes = np.array([len(v) // 8 for v in vectors])
            for number, (dim, codes) in enumerate(fitted.items()):
                at = np.flatnonzero(sizes == dim)
                if not len(at):
                    continue
                found, tables = codes.encode(_padded([vectors[i] for i in at], dim)), codes.tables
                buckets = (number << 48 | np.arange(tables) << 32 | found).reshape(-1)
                raw = [c.tobytes() for c in found.astype(np.uint32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))),
                     batch.column("key").take(pa.array(np.repeat(at, tables))),
                     pa.array(raw, pa.binary()).take(pa.array(np.repeat(np.arange(len(at)), tables)))],
                    names=["bucket", "table", "key", "code"])

    def code_rows(rows):
        """Codes (zeros after the tables of shorter ones, in both of a pair), and
        in how many signs each row's partners may differ."""
        raw = rows.column("code").to_pylist()
        wide = max(map(len, raw))
        codes = np.frombuffer(b"".join(c.ljust(wide, b"\0") for c in raw), np.uint32)
        return codes.reshape(len(raw), -1), limits[rows.column("bucket").to_numpy() >> 48]

    def retrieve(batches):
        """Members of a block that have a close partner in it."""
        for rows, group in whole_groups(batches, ["bucket", "low", "high"]):
            keep = np.zeros(len(group), bool)
            for left, right in _first_meetings(rows, group, *code_rows(rows)):
                keep[left] = keep[right] = True
            if keep.any():
                yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    def rerank(batches):
        for rows, group in whole_groups(batches, ["bucket", "low", "high"]):
            raw = rows.column("vector").to_pylist()
            sizes = np.array([len(r) // 8 for r in raw])
            vectors = _padded(raw, int(sizes.max()))
            weight = rows.column("rows").to_numpy()
            count = np.zeros(len(group), np.int64)
            keys = np.array(rows.column("key").to_pylist(), "V16")
            _, node = np.unique(keys, return_inverse=True)
            links = []
            for left, right in _first_meetings(rows, group, *code_rows(rows)):
                cosine = np.einsum("ij,ij->i", vectors[left], vectors[right])
                ok = (cosine >= threshold) & (sizes[left] == sizes[right])
                left, right = left[ok], right[ok]
                np.add.at(count, left, weight[right])
                np.add.at(count, right, weight[left])
                if len(left):
                    links.append(forest(node[left], node[right]))
            raw_keys = rows.column("key").to_pylist()
            linked = np.flatnonzero(count)
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raw_keys[i] for i in linked], pa.binary()),
                     pa.nulls(len(linked), pa.binary()), pa.array(count[linked])],
                    names=["a", "b", "links"])
                of = dict(zip(node.tolist(), raw_keys))
                a, b = forest(*map(np.concatenate, zip(*links)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([of[i] for i in a.tolist()], pa.binary()),
                     pa.array([of[i] for i in b.tolist()], pa.binary()),
                     pa.nulls(len(a), pa.int64())], names=["a", "b", "links"])

    members = nodes.select("key", "vector").mapInArrow(
        index, "bucket long, table int, key binary, code binary")
    members = stored(members, "vector-buckets")
    blocks = in_blocks(members, "bucket", "key", BLOCK).select(
        "bucket", F.col("block.low").alias("low"), F.col("block.high").alias("high"),
        "side", "table", "key", "code")
    close = stored(_blocks(blocks).mapInArrow(retrieve, blocks.schema), "vector-candidates")
    found = stored(_blocks(close.join(nodes, "key")).mapInArrow(
        rerank, "a binary, b binary, links long"), "vector-links")
    links = found.where("links is not null").groupBy(F.col("a").alias("key")) \
        .agg(F.sum("links").alias("links"))
    groups = components(found.where("b is not null").select("a", "b"))
    labelled = units.join(nodes.select("key", "rows"), "key", "left").join(links, "key", "left") \
        .join(groups.withColumnRenamed("node", "key"), "key", "left") \
        .withColumn("component", F.coalesce("component", "key"))
    least = labelled.where("component is not null").groupBy("component") \
        .agg(F.min("vec_id").alias("least"))
    return labelled.join(least, "component", "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("rows", F.lit(1)) - 1).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
