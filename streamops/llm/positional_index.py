"""Benchmark decontamination over a positional inverted index.

The index holds where in every training text the search terms stand. A window of
an item is looked up by its rarest terms: their positions, each less the term's
offset in the item, must meet in one alignment of item and text. What the
intersection leaves is compared word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamops.llm.common import stored
from streamops.llm.graph import FILTER_BITS, filter_bit, key_filter, passes
from streamops.llm.words import ALNUM, hash_words

WINDOW, ANCHORS = 10, 3
MASK = np.uint64(FILTER_BITS - 1)


def _split(texts: list) -> list[np.ndarray]:
    hashes, ends = hash_words(texts, ALNUM)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else []
    return [hashes[a:b] for a, b in zip(starts, ends)]


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, terms): each distinct row that has words, with their hashes."""
    def run(batches):
        for batch in batches:
            words = _split(batch.column("text").to_pylist())
            full = pa.array([len(w) > 0 for w in words], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("item_id"),
                 pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64()))],
                names=["item", "item_id", "terms"]).filter(full)

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct() \
        .withColumn("item", F.unhex(F.md5(F.concat_ws("\0", F.coalesce("item_id", F.lit("\1")),
                                                      "text").cast("binary"))))
    return rows.select("item", "item_id", "text").mapInArrow(
        run, "item binary, item_id string, terms array<long>")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of the terms stands in all of ``docs``."""
    bits = docs.sparkSession.sparkContext.broadcast(
        key_filter(terms, F.pmod("term", F.lit(FILTER_BITS))))

    def run(batches):
        for batch in batches:
            hashes, _ = hash_words(batch.column("text").to_pylist(), ALNUM)
            found, n = np.unique(hashes[passes(bits.value, hashes & MASK)], return_counts=True)
            yield pa.RecordBatch.from_pydict({"term": found.view(np.int64), "n": n})

    counts = docs.select("text").mapInArrow(run, "term long, n long") \
        .groupBy("term").agg(F.sum("n").alias("n"))
    return terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def plan(items: DataFrame, counts: DataFrame, width: int = WINDOW,
         anchors: int = ANCHORS) -> DataFrame:
    """(item, item_id, terms, lookups): per window of an item the offsets of its
    rarest terms, by count and then offset."""
    spread = items.select("item", F.posexplode("terms").alias("offset", "term"))
    ranked = spread.join(counts, "term").groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct("offset", "n"))).alias("counts"))

    def run(batches):
        for batch in batches:
            out = []
            for counts in batch.column("counts").to_pylist():
                n = [c["n"] for c in counts]
                size = min(width, len(n))
                out.append(sorted({tuple(sorted(sorted(
                    range(a, a + size), key=lambda i: (n[i], i))[:anchors]))
                    for a in range(len(n) - size + 1)}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("item_id"), batch.column("terms"),
                 pa.array(out, pa.list_(pa.list_(pa.int32())))],
                names=["item", "item_id", "terms", "lookups"])

    return items.join(ranked, "item").mapInArrow(
        run, "item binary, item_id string, terms array<long>, lookups array<array<int>>")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index, a row per document: doc_id, key (of its text), n_words,
    and the postings of the given terms as ``terms`` and ``positions``."""
    bits = docs.sparkSession.sparkContext.broadcast(
        key_filter(terms, F.pmod("term", F.lit(FILTER_BITS))))

    def run(batches):
        for batch in batches:
            hashes, ends = hash_words(batch.column("text").to_pylist(), ALNUM)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[:len(ends)]
            at = np.flatnonzero(passes(bits.value, hashes & MASK))
            cuts = pa.array(np.concatenate([np.searchsorted(at, starts), [len(at)]]).astype(np.int32))
            place = at - starts[np.searchsorted(ends, at, side="right")] if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(ends - starts, pa.int64()),
                 pa.ListArray.from_arrays(cuts, pa.array(hashes[at].view(np.int64))),
                 pa.ListArray.from_arrays(cuts, pa.array(place.astype(np.int32)))],
                names=["doc_id", "key", "n_words", "terms", "positions"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", _key().alias("key"), "text").mapInArrow(
        run, f"doc_id {kind}, key binary, n_words long, terms array<long>, positions array<int>"),
        "positional-index")


def _key():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def postings(index: DataFrame, planned: DataFrame) -> DataFrame:
    """(item, key, offset, delta): the anchors' postings less their offsets.
    Equal texts are looked up once."""
    anchors = planned.select("item", "terms", F.explode(F.array_distinct(F.flatten("lookups")))
                             .alias("offset")) \
        .select("item", "offset", F.element_at("terms", F.col("offset") + 1).alias("term"))
    once = index.where(F.size("terms") > 0).groupBy("key").agg(
        F.first(F.arrays_zip("terms", "positions")).alias("found"))
    spread = once.select("key", F.explode("found").alias("p")) \
        .select("key", F.col("p.terms").alias("term"), F.col("p.positions").alias("position"))
    return spread.join(anchors, "term").select(
        "item", "key", "offset", (F.col("position") - F.col("offset")).alias("delta"))


def intersect(index: DataFrame, planned: DataFrame) -> DataFrame:
    """(item, key, delta): alignments in which all lookups of some window meet."""
    meeting = postings(index, planned).groupBy("item", "key", "delta") \
        .agg(F.collect_set("offset").alias("offsets"))
    return meeting.join(planned.select("item", "lookups"), "item").where(
        F.exists("lookups", lambda w: F.size(F.array_except(w, F.col("offsets"))) == 0)) \
        .select("item", "key", "delta")


def proximity(index: DataFrame, planned: DataFrame, slop: int, least: int) -> DataFrame:
    """(item, key, near, n_terms): where at least ``least`` different anchors of an
    item have shifts less than ``slop`` apart, ``near`` being the least of these.
    Every run of shifts is tried, beginning at each one that occurs."""
    run = Window.partitionBy("item", "key").orderBy("delta").rangeBetween(0, slop - 1)
    return postings(index, planned).distinct() \
        .withColumn("n_terms", F.size(F.collect_set("offset").over(run))) \
        .where(F.col("n_terms") >= least) \
        .groupBy("item", "key", F.col("delta").alias("near")).agg(F.max("n_terms").alias("n_terms"))


def hits_of(words: np.ndarray, terms: np.ndarray, delta: int, width: int) -> np.ndarray:
    """Positions of ``words`` inside whole windows of the item at this alignment."""
    a, b = max(0, delta), min(len(words), delta + len(terms))
    size = min(width, len(terms))
    if b - a < size:
        return np.zeros(0, np.int64)
    equal = words[a:b] == terms[a - delta:b - delta]
    runs = np.diff(np.concatenate([[0], equal.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1)
    found = [np.arange(s, e) for s, e in zip(starts, ends) if e - s >= size]
    return np.concatenate(found) + a if found else np.zeros(0, np.int64)


def phrase_matches(docs: DataFrame, found: DataFrame, planned: DataFrame,
                   width: int = WINDOW) -> DataFrame:
    """(key, n_hit, items): the alignments that hold word by word, by text."""
    spark = docs.sparkSession
    wanted = stored(found.join(planned.select("item", "item_id", "terms"), "item")
                    .groupBy("key", "item_id", "item", "terms")
                    .agg(F.collect_list("delta").alias("deltas"))
                    .groupBy("key").agg(F.collect_list(F.struct("item_id", "terms", "deltas"))
                                        .alias("found")), "alignments")
    bits = spark.sparkContext.broadcast(key_filter(wanted, "key"))

    def read(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits.value, batch.column("bit").to_numpy())))
            words = _split(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([w.tobytes() for w in words], pa.binary())],
                names=["key", "words"])

    def check(batches):
        for batch in batches:
            n_hit, items = [], []
            for data, rows in zip(batch.column("words").to_pylist(), batch.column("found").to_pylist()):
                words, hit, ids = np.frombuffer(data, np.uint64), set(), []
                for row in rows:
                    terms = np.array(row["terms"], np.int64).view(np.uint64)
                    at = [hits_of(words, terms, d, width) for d in row["deltas"]]
                    at = np.concatenate(at)
                    if len(at):
                        ids.append(row["item_id"] or "")
                        hit.update(at.tolist())
                n_hit.append(len(hit))
                items.append(sorted(set(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n_hit, pa.int64()),
                 pa.array(items, pa.list_(pa.string()))], names=["key", "n_hit", "items"])

    texts = docs.select("text").where("text is not null").select(_key().alias("key"), "text") \
        .withColumn("bit", filter_bit("key")).select("key", "bit", "text") \
        .mapInArrow(read, "key binary, words binary")
    once = texts.groupBy("key").agg(F.first("words").alias("words"))
    return once.join(wanted, "key").mapInArrow(check, "key binary, n_hit long, items array<string>") \
        .where("n_hit > 0")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_words, n_hit, items): one row per document.

    Null texts have no words and a null key; equal texts share one lookup; items
    without words, with null texts or repeated as a whole add nothing; items that
    share an item_id are one item, as are all without one, which are listed as
    empty text. Without items nothing is hit.
    """
    items = stored(item_terms(benchmark.where("text is not null")), "items")
    terms = items.select(F.explode("terms").alias("term")).distinct()
    planned = stored(plan(items, term_counts(docs, terms), width), "lookups")
    rare = planned.select("terms", F.explode(F.flatten("lookups")).alias("offset")) \
        .select(F.element_at("terms", F.col("offset") + 1).alias("term")).distinct()
    index = build_index(docs, rare)
    hits = stored(phrase_matches(docs, intersect(index, planned), planned, width), "phrase-hits")
    return index.select("doc_id", "key", "n_words").join(hits, "key", "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
