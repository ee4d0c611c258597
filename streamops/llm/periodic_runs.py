"""Periodic runs of words by seeds and diagonals.

A run of period q holds, on the diagonal of lag q, at least ``max(6, 4 q) - q``
words that equal the word q on. Lags are cut into classes that double, and for
each class all k-grams of its least overlap are indexed: every run of the class
then holds one. Two places of a document with the same k-gram and no such place
between them, at a distance of the class, are a seed. As k is no less than q, in
a run of smallest period q the next place of a k-gram is exactly q on, so these
neighbouring pairs are all that is needed, however often a k-gram occurs. A seed
is extended both ways along its diagonal; per lag, the furthest place covered so
far suppresses seeds inside what has been extended already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
# Texts are taken together up to so many bytes; a longer one by itself.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Words:
    """The words of some texts: ``ids`` of equal words are equal, ``ends`` says
    where each text's words end, ``values`` are the words themselves."""

    ids: np.ndarray
    ends: np.ndarray
    values: pa.Array


def split(texts: pa.Array) -> Words:
    """Words between ASCII white space of an array of binary texts; null has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_binary()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    # A word starts at a byte inside one whose neighbour is not, or whose text starts there.
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][(offsets[:-1] < len(data))]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    before = np.concatenate([[0], np.cumsum(inside)])
    kept = data[inside]
    cuts = np.append(before[starts], len(kept)).astype(np.int64)
    values = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(kept)])
    ids = pc.dictionary_encode(values).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(ids, np.searchsorted(starts, offsets[1:]), values)


def lag_classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """(least lag, greatest lag, k) of each class; k is the overlap any of its runs has."""
    low, high = 1, 1
    while low * LEAST_PERIODS <= longest or low == 1:
        yield low, high, max(LEAST_WORDS, LEAST_PERIODS * low) - low
        low, high = high + 1, 2 * high


def _seeds(words: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, lags): neighbouring places of a k-gram, class by class.

    ``stop`` is where the document of each word ends. Only places whose k-gram
    occurs again stay for the next, longer k-gram: the longer one could not occur
    again elsewhere. Numbers of k-grams are exact: the longer one is the pair of
    the shorter ones it starts and ends with.
    """
    place = np.arange(len(words))
    number, k = words, 1
    longest = int((stop - place).max(initial=0))
    for low, high, wider in lag_classes(longest):
        while k < wider and len(place):
            step = min(wider - k, k)
            at = np.searchsorted(place, place + step)
            at[at == len(place)] = 0
            whole = (place + k + step <= stop[place]) & (place[at] == place + step)
            pairs = number[whole] * (int(number.max(initial=0)) + 1) + number[at[whole]]
            place = place[whole]
            number = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            k += step
            order = np.argsort(number, kind="stable")
            again = (number[order[1:]] == number[order[:-1]]) & (place[order[1:]] < stop[place[order[:-1]]])
            stays = np.zeros(len(place), bool)
            stays[order[1:]] = again
            stays[order[:-1]] |= again
            place, number = place[stays], number[stays]
        if not len(place):
            return
        order = np.argsort(number, kind="stable")
        left, right = place[order[:-1]], place[order[1:]]
        lag = right - left
        seed = (number[order[1:]] == number[order[:-1]]) & (right < stop[left]) & (lag >= low) & (lag <= high)
        yield left[seed], lag[seed]


def _reach(words: np.ndarray, at: int, lag: int, bound: int, step: int) -> int:
    """From ``at`` on, in the direction ``step``, the first place on the diagonal
    whose words differ, or ``bound``; in stretches that double."""
    size = 64
    while at != bound:
        n = min(size, abs(bound - at))
        here = np.arange(at, at + step * n, step)
        differs = np.flatnonzero(words[here] != words[here + lag])
        if len(differs):
            return at + step * int(differs[0])
        at += step * n
        size *= 2
    return bound


def runs(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """An array of (start, length, period), by start and then period, for words of
    documents that end at ``ends``; places are counted over all documents."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - begins
    begin, stop = np.repeat(begins, sizes), np.repeat(ends, sizes)
    covered: dict[int, int] = {}
    found = []
    for places, lags in _seeds(words, stop):
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        # Seeds that follow one another on a diagonal: the first stands for all.
        head = np.ones(len(places), bool)
        head[1:] = (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)
        for at, lag in zip(places[head].tolist(), lags[head].tolist()):
            if at < covered.get(lag, 0):
                continue
            start = _reach(words, at - 1, lag, int(begin[at]) - 1, -1) + 1
            end = _reach(words, at, lag, int(stop[at]) - lag, 1)
            covered[lag] = end
            length = end - start + lag
            if length >= max(LEAST_WORDS, LEAST_PERIODS * lag) and _smallest(words[start:start + 2 * lag]) == lag:
                found.append((start, length, lag))
    out = np.array(sorted(found), np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _smallest(square: np.ndarray) -> int:
    """The smallest period of a stretch twice as long as a period it has: the
    smallest divides that one, as the stretch is long enough for both."""
    lag = len(square) // 2
    rest, least = lag, lag
    for prime in _primes(lag):
        while least % prime == 0:
            shorter = least // prime
            if not (square[shorter:lag + shorter] == square[:lag]).all():
                break
            least = shorter
    return least


def _primes(n: int) -> Iterator[int]:
    p = 2
    while p * p <= n:
        if n % p == 0:
            yield p
            while n % p == 0:
                n //= p
        p += 1
    if n > 1:
        yield n


def strongest(found: np.ndarray) -> int:
    """Which run has the greatest length per period, exactly; of equals the first."""
    best = 0
    for k in range(1, len(found)):
        if int(found[k, 1]) * int(found[best, 2]) > int(found[best, 1]) * int(found[k, 2]):
            best = k
    return best


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Of ``n`` words those outside what any run repeats after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) == 0)


_SCHEMA = ("n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string, collapsed binary")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _joined(words: pa.Array, pick: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The picked words of each text, joined by one space."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    picked = words.take(pa.array(pick)).cast(pa.binary())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, picked), b" ")


def _detect(texts: bool, planted: bool):
    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                yield one(part)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split(batch.column("_text"))
        ends = words.ends
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        source = np.arange(len(words.ids))
        if planted:
            for k, h in enumerate(batch.column("_hash").to_pylist()):
                lo, n = int(begins[k]), int(ends[k] - begins[k])
                if h % 10 == 0 and n:
                    a, p = plant(h, n)
                    source[lo + a:lo + n] = lo + a + np.arange(n - a) % p
        found = runs(words.ids[source], ends)
        cut = np.searchsorted(found[:, 0], np.append(begins, ends[-1] if len(ends) else 0))
        rows, picks, counts = [], [], []
        for k, (lo, hi) in enumerate(zip(begins.tolist(), ends.tolist())):
            own = found[cut[k]:cut[k + 1]] - [lo, 0, 0]
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in own.tolist())
            best = own[strongest(own)].tolist() if len(own) else None
            rows.append((hi - lo, len(own), *(best or [None] * 3),
                         1000 * best[1] // best[2] if best else None,
                         hashlib.sha256(listed.encode()).hexdigest()))
            picks.append(source[lo:hi] if not len(own) else source[lo + kept_words(hi - lo, own)])
            counts.append(len(picks[-1]))
        joined = _joined(words.values, np.concatenate(picks) if picks else np.zeros(0, np.int64), np.array(counts, np.int64))
        digests = [hashlib.sha256(t.as_buffer()).hexdigest() for t in joined]
        columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:6]]
        columns += [pa.array([r[6] for r in rows]), pa.array(digests),
                    joined if texts else pa.nulls(len(rows), pa.binary())]
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        own = [batch.column(c) for c in batch.schema.names if c not in ("_text", "_hash")]
        return pa.RecordBatch.from_arrays(own + columns, names=[
            c for c in batch.schema.names if c not in ("_text", "_hash")] + names)
    return run


def plant(h: int, n: int) -> tuple[int, int]:
    """(a, p): from word ``a`` on, the text repeats its next ``p`` words."""
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", planted: bool = False,
         texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256, collapsed): one row per row of ``docs``.

    A run is a stretch of words of smallest period ``period``, at least
    ``max(6, 4 * period)`` words long, that no neighbouring word extends. Named
    is the one of the greatest length per period; ``collapsed`` is the text with
    each run cut to its first period and words joined by one space. ``planted``
    first plants repetitions into the texts whose id's crc32 ends in 0, a test of
    the search at any scale.

    A null or empty text, or one of white space, has no words, no runs and an
    empty collapsed text. Rows are judged each by itself: repeated rows come out
    as often as they go in, a null id is planted as the empty text. A long text
    is taken whole, its cost is n log n in its words. Other columns are not read,
    whatever their names. An empty table gives no rows.
    """
    number = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("_text"), number.alias("_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_detect(texts, planted), f"doc_id {kind}, {_SCHEMA}")
