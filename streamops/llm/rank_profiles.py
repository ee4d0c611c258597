"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent letter n-grams (one to three
characters, words padded with a space) in rank order, counted over every
training document. A document's own ranking is compared with each profile by the
out-of-place distance: the sum over the document's n-grams of how far their two
ranks lie apart, the profile length where the profile lacks the n-gram.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.llm.common import fold, stored

PROFILE_SIZE = 400
# Texts looked at together: the n-grams of so many are in memory at a time.
TOGETHER = 64
UNKNOWN = "und"
SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, owner, alphabet): every n-gram of every text as a number, and the
    text it comes from. Keys order as the n-grams do: shorter ones first, then by
    code points; ``alphabet`` turns them into portable numbers (``packed``)."""
    # Trailing-space padding: one space between two texts serves both.
    data = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
            for t in texts]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(d) for d in data])
    chars = np.concatenate(data) if data else np.zeros(0, np.uint32)
    space = ~_letters()[chars]
    keep = ~space
    keep[:1] = True
    keep[1:] |= ~space[:-1]
    chars = np.where(space, SPACE, chars)[keep]
    owner, space = owner[keep], space[keep]
    alphabet, dense = np.unique(chars, return_inverse=True)
    size = np.int64(max(1, len(alphabet)))
    dense = dense.astype(np.int64)
    two = dense[:-1] * size + dense[1:]
    three = two[:-1] * size + dense[2:]
    good1, good2 = ~space, ~(space[:-1] & space[1:])
    good3 = ~space[1:-1]
    keys = np.concatenate([dense[good1], size + two[good2], size + size**2 + three[good3]])
    owners = np.concatenate([owner[good1], owner[1:][good2], owner[2:][good3]])
    return keys, owners, alphabet.astype(np.int64)


def packed(keys: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Keys as 21 bits per character, the same in every batch."""
    size = np.int64(max(1, len(alphabet)))
    out = np.zeros(len(keys), np.int64)
    one, two = keys < size, (keys >= size) & (keys < size + size**2)
    three = keys >= size + size**2
    out[one] = alphabet[keys[one]]
    k = keys[two] - size
    out[two] = alphabet[k // size] << 21 | alphabet[k % size]
    k = keys[three] - size - size**2
    out[three] = (alphabet[k // size**2] << 42 | alphabet[k // size % size] << 21
                  | alphabet[k % size])
    return out


def counted(keys: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(alphabet)
    if size + size**2 + size**3 <= 1 << 22:
        counts = np.bincount(keys)
        found = np.flatnonzero(counts)
        return packed(found, alphabet), counts[found]
    found, counts = np.unique(keys, return_counts=True)
    return packed(found, alphabet), counts


def _count(batches):
    """Counts of each batch, merged up to a bound before they leave the task."""
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)
            for at in range(0, len(keys), 100_000):
                k = keys[at:at + 100_000]
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang] * len(k), "gram": k, "n": sums[at:at + 100_000]})

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        for lang in set(langs):
            own = [t for t, x in zip(texts, langs) if x == lang]
            for at in range(0, len(own), TOGETHER):
                keys, _, alphabet = ngrams(own[at:at + TOGETHER])
                part = counted(keys, alphabet)
                held.setdefault(lang, []).append(part)
                size += len(part[0])
        if size > 1 << 21:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def learn(labelled: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """Profiles (lang, gram, rank) from all rows of ``labelled`` (text, lang).

    Rows with a null text or lang teach nothing. Equal counts rank by n-gram.
    What a language holds is its n-gram inventory, not its documents.
    """
    rows = labelled.select("lang", "text").where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size) \
        .select("lang", "gram", "rank")


class Profiles:
    def __init__(self, rows: list, size: int):
        self.langs = sorted({r.lang for r in rows})
        self.size = size
        self.grams = np.array(sorted({r.gram for r in rows}), np.int64)
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int32)
        if rows:
            where = np.searchsorted(self.grams, [r.gram for r in rows])
            self.ranks[[at[r.lang] for r in rows], where] = [r.rank for r in rows]

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a ranked list of n-grams to each profile."""
        at = np.searchsorted(self.grams, grams)
        found = np.zeros(len(grams), bool)
        inside = at < len(self.grams)
        found[inside] = self.grams[at[inside]] == grams[inside]
        ranks = self.ranks[:, np.where(found, at, len(self.grams))]
        apart = np.abs(ranks - np.arange(len(grams), dtype=np.int32))
        return np.where(ranks < 0, self.size, apart).sum(axis=1)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        keys, owners, alphabet = ngrams(texts)
        order = np.argsort(owners, kind="stable")
        keys = keys[order]
        ends = np.searchsorted(owners[order], np.arange(len(texts) + 1))
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if a == b or not self.langs:
                out.append((UNKNOWN, 0.0))
                continue
            found, counts = np.unique(keys[a:b], return_counts=True)
            top = np.argsort(-counts, kind="stable")[:self.size]
            grams = packed(found[top], alphabet)
            away = self.distances(grams)
            near = 1.0 - away / (self.size * len(grams))
            best = int(np.argmin(away))  # the first language of equal ones
            total = float(near.sum())
            out.append((self.langs[best], min(1.0, float(near[best]) / total) if total > 0
                        else 1.0 / len(self.langs)))
        return out


def identify(docs: DataFrame, profiles: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """``docs`` with lang_pred and score (its share of the profiles' closeness).

    ``und`` and 0 where the text is null or has no letter, or nothing was learned.
    Texts are read whole; ties go to the first language by name; columns of these
    two names are replaced. The profiles (``size`` rows per language) are
    collected and sent to the tasks.
    """
    model = Profiles(profiles.collect(), size)
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in names] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [p for at in range(0, len(texts), TOGETHER)
                     for p in model.predict(texts[at:at + TOGETHER])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array([lang for lang, _ in found], pa.string()),
                   pa.array([s for _, s in found], pa.float64())],
                names=names + ["lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def learn_folds(docs: DataFrame) -> DataFrame:
    """Profiles from the documents outside the held-out third, stored once."""
    return stored(learn(docs.where(fold("doc_id", 3) != 1)), "lang-profiles")
