"""Quality scores from supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams (three and four code
points, in any script) are hashed to rows of an embedding table; a document is the mean of its features' vectors, a softmax layer turns it
into class probabilities, and both are learned together by stochastic gradient
descent in numpy. With a linear layer on top, each feature's contribution to the
score is one number, so scoring is a gather and a mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.llm.common import fold
from streamops.llm.words import hash_words

BUCKETS, DIM = 1 << 17, 8
# The classifier is fitted on at most this many labelled documents.
SAMPLE, EPOCHS, RATE = 4000, 5, 0.5
AS_IS = bytes(32 if b in b" \t\n\v\f\r" else b for b in range(256))
CUTOFF = 0.3
BY_THREE, BY_FOURTH, BY_FOUR = map(np.uint64, (
    0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ends): the features of all texts in order, repeated as they occur,
    and where each text's end. Letter case counts."""
    parts, ends, n = [], [], 0
    hashes, stops = hash_words(texts, AS_IS)
    words = (hashes % np.uint64(BUCKETS)).astype(np.int32)
    # A pair's hash joins its words' by XOR: every word that repeats the one
    # before it gives the same pair, whatever the word.
    pairs = ((hashes[1:] ^ hashes[:-1]) % np.uint64(BUCKETS - 1)).astype(np.int32)
    at = 0
    for text, stop in zip(texts, stops.tolist()):
        data = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        found = [words[at:stop], pairs[at:max(at, stop - 1)]]
        if len(data) >= 3:
            three = (data[:-2] | data[1:-1] << np.uint64(21) | data[2:] << np.uint64(42)) * BY_THREE
            found.append(_bucket(three))
            if len(data) >= 4:
                found.append(_bucket((three[:-1] ^ data[3:] * BY_FOURTH) * BY_FOUR))
        parts += found
        n += sum(map(len, found))
        ends.append(n)
        at = stop
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.array(ends, np.int64)


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(47)).astype(np.int32)


class Classifier:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
        self.layer = np.zeros((DIM, 2))
        self.bias = np.zeros(2)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS,
            rate: float = RATE, seed: int = 6) -> None:
        """rows: (distinct buckets, their counts, label)."""
        rng = np.random.default_rng(seed)
        steps, done = max(1, epochs * len(rows)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                buckets, counts, label = rows[i]
                step = rate * (1 - done / steps)
                done += 1
                share = counts / max(1, counts.sum())
                rows_of = self.vectors[buckets]
                mean = share @ rows_of
                error = softmax(mean @ self.layer + self.bias)
                error[label] -= 1
                back = self.layer @ error
                self.layer -= step * np.outer(mean, error)
                self.bias -= step * error
                # As one update for each feature, not for its share of the mean:
                # otherwise a long text's vectors would hardly move.
                self.vectors[buckets] = rows_of - step * np.minimum(1, share * len(share))[:, None] * back

    def contributions(self) -> tuple[np.ndarray, float]:
        """Each bucket's log odds of label 1, and the bias's."""
        return ((self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32),
                float(self.bias[1] - self.bias[0]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier from at most ``sample`` documents with a non-null label, chosen
    by hash of the id. Of repeated ids one row counts. Without any, every score
    is 0.5."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id") \
        .agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            buckets, ends = features(batch.column("text").to_pylist())
            out, at = [], 0
            for end in ends.tolist():
                found, counts = np.unique(buckets[at:end], return_counts=True)
                out.append(np.stack([found, counts]).astype(np.int32).tobytes())
                at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(out, pa.binary())],
                names=["doc_id", "quality", "features"])

    # The chosen labels are bounded by ``sample``: small enough to be sent around.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id") \
        .select("doc_id", F.col("quality").cast("int").alias("quality"), "text") \
        .mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, "
                         "features binary") \
        .groupBy("doc_id", "quality").agg(F.min("features").alias("features")).collect()
    rows.sort(key=lambda r: r.doc_id)
    classifier = Classifier()
    classifier.fit([(*np.frombuffer(bytes(r.features), np.int32).reshape(2, -1), r.quality)
                    for r in rows])
    return classifier


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``docs`` with score, the probability of label 1, for whole texts.

    A null or empty text has no features and gets the bias's score; a column
    named score is replaced; equal texts score alike.
    """
    weights, bias = classifier.contributions()
    table = docs.sparkSession.sparkContext.broadcast(weights)  # 512 KB, fixed
    names = [c for c in docs.columns if c.lower() != "score"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            buckets, ends = features(texts)
            sums = np.concatenate([[0.0], np.cumsum(table.value[buckets], dtype=np.float64)])
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[:len(ends)]
            mean = (sums[ends] - sums[starts]) / np.maximum(1, ends - starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(1 / (1 + np.exp(-(mean + bias))))],
                names=names + ["score"])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels outside the held-out fifth."""
    return labels.where(fold("doc_id", 5) != 0).select("doc_id", "quality")
