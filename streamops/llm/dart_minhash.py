"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set: its runs of five words with how often each occurs.
Darts are thrown into the weighted region of every element (one cell for each
unit of weight) along a rank axis cut into slabs of doubling width; cell and slab
seed how many darts there are (Poisson) and where, so equal cells of two
documents get equal darts. A coordinate of the signature keeps its earliest dart,
and slabs are thrown only until every coordinate has one. Two documents agree in
a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamops.llm.common import stored
from streamops.llm.graph import (
    components,
    filter_bit,
    group_pairs,
    in_blocks,
    key_filter,
    passes,
    whole_groups,
)
from streamops.llm.words import ALNUM, hash_words, mix, shingles

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
COORDINATES = BANDS * ROWS
FIRST_SLAB = 1 / 64
# Signatures that agree in fewer coordinates belong to no pair of the threshold:
# at 0.8 that is five standard deviations.
LEAST_AGREEING = int(0.62 * COORDINATES)
BLOCK = 512
# For the pairs left at last: more coordinates, a byte of each; again over four
# standard deviations.
FINE = 512
LEAST_FINE = int(0.72 * FINE)


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 24))
    logs = n * np.log(mean) - mean - np.concatenate([[0], np.cumsum(np.log(n[1:]))])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def signatures(elements: np.ndarray, owner: np.ndarray, n: int,
               size: int = COORDINATES) -> np.ndarray:
    """An n x ``size`` array of dart ids for n sets.

    ``elements`` are hashes, repeated as often as the element's weight says,
    ``owner`` the set of each. A set without elements keeps the largest value in
    every coordinate.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * size, empty, np.uint64)
    order = np.lexsort((elements, owner))
    elements, owner = elements[order], owner[order].astype(np.int64)
    # The w-th repetition is the cell of weight w.
    new = np.ones(len(elements), bool)
    new[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(elements))
    weight = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        cells = mix(elements + weight.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    active = np.ones(n, bool)
    for slab in range(60):
        mine = active[owner]
        if not mine.any():
            break
        if not mine.all():
            cells, owner = cells[mine], owner[mine]
        width = FIRST_SLAB * (1 if slab == 0 else 2.0 ** (slab - 1))
        with np.errstate(over="ignore"):
            seed = mix(cells + np.uint64((slab + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        table = _poisson_table(width)
        uniform = (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53
        hit = np.flatnonzero(uniform >= table[0])
        count = np.searchsorted(table, uniform[hit], side="right")
        dart = np.repeat(hit, count)
        number = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            dart_id = mix(seed[dart] + (number + 1).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        # Earlier slab, then place within the slab: the order of the ranks.
        value = np.uint64(slab << 58) | dart_id >> np.uint64(6)
        coordinate = (mix(dart_id) % np.uint64(size)).astype(np.int64)
        np.minimum.at(best, owner[dart] * size + coordinate, value)
        active &= (best.reshape(n, size) == empty).any(axis=1)
    return best.reshape(n, size)


def band_keys(signature: np.ndarray) -> np.ndarray:
    out = np.zeros((len(signature), BANDS), np.uint64)
    rows = signature.reshape(len(signature), BANDS, ROWS)
    with np.errstate(over="ignore"):
        out += np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(ROWS):
            out = mix(out * np.uint64(0x100000001B3) + rows[:, :, r])
    return out


def _sets(texts: list) -> list[np.ndarray]:
    hashes, ends = hash_words(texts, ALNUM)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else []
    return [shingles(hashes[a:b], WIDTH) for a, b in zip(starts, ends)]


def _sign(batches):
    for batch in batches:
        sets = _sets(batch.column("text").to_pylist())
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        found = signatures(elements, owner, len(sets))
        full = sizes > 0
        bands = band_keys(found).view(np.int64)
        small = mix(found).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"),
             pa.array([b if ok else [] for b, ok in zip(bands, full)], pa.list_(pa.int64())),
             pa.array([s.tobytes() for s in small], pa.binary())],
            names=["doc_id", "key", "bands", "signature"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of repeated elements."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    both, first = both[order], order < len(a)
    starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    mine = np.add.reduceat(first.astype(np.int64), starts)
    all_ = np.diff(np.append(starts, len(both)))
    shared = int(np.minimum(mine, all_ - mine).sum())
    return shared / (len(both) - shared)


def _of_keys(docs: DataFrame, wanted: DataFrame, name: str, make) -> DataFrame:
    """(key, ``name``): what ``make`` gives for the sets of the wanted texts alone."""
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, "key"))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits.value, batch.column("bit").to_numpy())))
            made = make(_sets(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.binary())],
                                             names=["key", name])

    rows = keyed(docs.select("text").where("text is not null")) \
        .withColumn("bit", filter_bit("key")).mapInArrow(run, f"key binary, {name} binary")
    return stored(rows.groupBy("key").agg(F.first(name).alias(name)), f"dart-{name}")


def _sorted(sets: list) -> list[bytes]:
    return [np.sort(s).tobytes() for s in sets]


def _finer(sets: list) -> list[bytes]:
    """The finer signature and, after its FINE bytes, the sorted set itself."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found = signatures(np.concatenate(sets) if sets else np.zeros(0, np.uint64), owner, len(sets), FINE)
    return [row.tobytes() + one for row, one in zip(mix(found).astype(np.uint8), _sorted(sets))]


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b of keys) whose sets are as similar as the threshold asks.

    Only texts some pair names are hashed again; a pair then travels once with
    either set.
    """
    def compare(batches):
        for batch in batches:
            ok = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= THRESHOLD
                  for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    named = pairs.select(F.col("a").alias("key")).distinct().union(pairs.select("b").distinct())
    sets = _of_keys(docs, named, "sets", _sorted)
    return pairs.join(sets.select(F.col("key").alias("a"), F.col("sets").alias("x")), "a") \
        .join(sets.select(F.col("key").alias("b"), F.col("sets").alias("y")), "b") \
        .select("a", "b", "x", "y").mapInArrow(compare, "a binary, b binary")


def _block(rows: pa.Table) -> tuple[np.ndarray, list, np.ndarray]:
    """side, key and component (numbered) of the rows of blocks."""
    component = np.unique(np.array(rows.column("component").to_pylist(), "V16"), return_inverse=True)[1]
    return rows.column("side").to_numpy(), rows.column("key").to_pylist(), component


def _alike(group, side, component, signature, least: int):
    """(left, right, agreeing) of pairs in different components that agree enough."""
    for left, right in group_pairs(group, side, 1 << 14):
        apart = component[left] != component[right]
        left, right = left[apart], right[apart]
        alike = (signature[left] == signature[right]).sum(axis=1)
        near = alike >= least
        yield left[near], right[near], alike[near]


def _nearest(batches):
    """Each member of a block with its most similar one of another component: a row
    at most per member."""
    for rows, group in whole_groups(batches, ["bucket", "low", "high"]):
        side, key, component = _block(rows)
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32) \
            .reshape(len(side), -1)
        best = np.full(len(side), LEAST_AGREEING << 32, np.int64)
        for left, right, alike in _alike(group, side, component, signature, LEAST_AGREEING):
            np.maximum.at(best, left, (alike << 32) + right + 1)
            np.maximum.at(best, right, (alike << 32) + left + 1)
        other = (best & 0xFFFFFFFF) - 1
        has = np.flatnonzero(other >= 0)
        yield from _pairs(key, has, other[has])


def _forest(batches):
    """Links of the threshold in a block, as a forest of its components: the most
    alike pairs first, none between ends that are joined by then, each checked
    with the sets themselves. Fewer rows than the block has."""
    for rows, group in whole_groups(batches, ["bucket", "low", "high"]):
        side, key, component = _block(rows)
        packed = rows.column("signature").to_pylist()
        signature = np.frombuffer(b"".join(p[:FINE] for p in packed), np.uint8).reshape(len(side), FINE)
        sets = [np.frombuffer(p, np.uint64, offset=FINE) for p in packed]
        # A component may be in several blocks of these rows: those are joined apart.
        node = np.unique(np.stack([group, component]), axis=1, return_inverse=True)[1].ravel()
        root = list(range(int(node.max(initial=-1)) + 1))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = list(_alike(group, side, component, signature, LEAST_FINE))
        left, right, alike = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)
                              for k in range(3))
        links = []
        for at in np.argsort(-alike, kind="stable").tolist():
            i, j = int(left[at]), int(right[at])
            a, b = top(int(node[i])), top(int(node[j]))
            if a != b and similarity(sets[i], sets[j]) >= THRESHOLD:
                root[a] = b
                links.append((i, j))
        if links:
            yield from _pairs(key, *np.array(links).T)


def _pairs(key: list, left: np.ndarray, right: np.ndarray):
    pairs = [(key[i], key[j]) for i, j in zip(left.tolist(), right.tolist())]
    if pairs:
        yield pa.RecordBatch.from_arrays(
            [pa.array([min(p) for p in pairs], pa.binary()),
             pa.array([max(p) for p in pairs], pa.binary())], names=["a", "b"])


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, key, component) of buckets that hold more than one component."""
    labelled = members.select("bucket", "key").join(
        found.withColumnRenamed("node", "key"), "key", "left") \
        .withColumn("component", F.coalesce("component", "key"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")) \
        .where("x <> y").select("bucket")
    return labelled.join(mixed, "bucket")


def _candidates(rows: DataFrame, near) -> DataFrame:
    blocks = in_blocks(rows, "bucket", "key", BLOCK).select(
        F.col("block.bucket").alias("bucket"), F.col("block.low").alias("low"),
        F.col("block.high").alias("high"), "side", "key", "component", "signature")
    return blocks.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high") \
        .mapInArrow(near, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, component, component_id): one row per document.

    ``component_id`` is the smallest doc_id among the documents linked to this
    one through equal texts or texts of weighted similarity 0.8 or more. A null
    text links with nothing and is its own component; a text without words links
    with equal texts only; equal rows share everything. Equal texts are one node
    throughout, so copies, however many, cost one row each.

    Candidates share a band. First every text is checked against the smallest of
    each of its bands' buckets, then, in blocks of bounded size, against the member
    of another component whose signature is the most similar: both linear in the
    bucket. What is then still apart is checked pair by pair inside the blocks,
    which hand on a forest of the links they have verified.
    """
    text = keyed(docs.select("doc_id", "text").where("text is not null"))
    signed = stored(text.select("doc_id", "key", "text").mapInArrow(
        _sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, "
               "bands array<long>, signature binary"), "dart-signatures")
    nodes = signed.groupBy("key").agg(F.first("bands").alias("bands"),
                                      F.first("signature").alias("signature"))
    members = stored(nodes.select("key", F.explode("bands").alias("bucket")), "dart-buckets")
    heads = members.groupBy("bucket").agg(F.min("key").alias("head"), F.count("*").alias("n")) \
        .where("n > 1").drop("n")
    members = stored(members.join(heads, "bucket"), "dart-members")
    stars = stored(members.where("key <> head")
                   .select(F.col("head").alias("a"), F.col("key").alias("b")).distinct(), "dart-stars")
    links = stored(verified(docs, stars), "dart-links")
    rows = _apart(members, components(links)).join(nodes.select("key", "signature"), "key")
    near = stored(_candidates(rows, _nearest), "dart-near")
    more = near.join(stars, ["a", "b"], "left_anti")
    links = stored(links.union(verified(docs, more)), "dart-links")
    # Who had no partner in another component has none now: components only grow.
    paired = near.select(F.col("a").alias("key")).union(near.select("b")).distinct()
    rows = stored(_apart(members.join(paired, "key", "left_semi"), components(links)), "dart-apart")
    fine = _of_keys(docs, rows.select("key"), "signature", _finer)
    links = stored(links.union(_candidates(rows.join(fine, "key"), _forest)), "dart-links")
    final = components(links)

    ids = signed.select("doc_id", "key").join(final.withColumnRenamed("node", "key"), "key", "left") \
        .withColumn("component", F.coalesce("component", "key"))
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = ids.join(least, "component").select("doc_id", "key", "component", "component_id")
    alone = docs.where("text is null").select(
        "doc_id", F.lit(None).cast("binary").alias("key"),
        F.lit(None).cast("binary").alias("component"), F.col("doc_id").alias("component_id"))
    return found.union(alone)
