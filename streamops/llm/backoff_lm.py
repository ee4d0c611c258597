"""Language-model scores from a weighted backoff automaton.

Training bigrams, smoothed by Witten-Bell, are arcs of an automaton whose states
are histories: the root, and one state per word. A state has an arc for every
word that followed it in training; all other words take its failure arc, which
costs the state's backoff weight and leads to the root, whose arcs are the
additively smoothed words. A text is read once from left to right: the state is
the last word, and log-probabilities add up.

The automaton is never gathered in one place. Blocks of documents send the words
and bigrams they hold, with their own training counts, to the task in charge of
the word's hash range; there counts of all blocks are summed, and each block gets
back just the states and arcs its own texts can reach. Bigrams of a hot first word
are spread over all ranges by a hash of both words; how many followers such a word
has is summed over the ranges.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamops.llm.common import fold_of, stored
from streamops.llm.words import NON_SPACE, hash_words

ADDED = 0.1
BLOCK_TOKENS = 1_500_000
RANGE_TOKENS = 1_500_000  # tokens behind one hash range: what its task holds at a time
END = np.uint64(0x5DEECE66D1234567)
FOLLOWER = np.uint64((1 << 48) - 1)
BLOCKS = ("block string, doc_ids array<{id}>, held array<boolean>, ends array<long>, "
          "words binary, tokens binary, n_tokens long")


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, each text closed by the end token."""
    hashes, ends = hash_words(texts, NON_SPACE)
    return np.insert(hashes, ends, END), ends + np.arange(1, len(ends) + 1)


def blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Documents as numbered words, a row per block of bounded size: stored once,
    so a block keeps its documents however often tasks are repeated."""
    def pack(ids, held, hashes, ends):
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        return pa.RecordBatch.from_pydict({
            "block": [uuid.uuid4().hex], "doc_ids": pa.array([ids], pa.list_(kind)),
            "held": [held], "ends": [np.cumsum(ends)],
            "words": pa.array([steps(words)], pa.binary()),
            "tokens": pa.array([planes(tokens, 4)], pa.binary()),
            "n_tokens": [len(tokens)]})

    kind = pa.int32() if docs.schema["doc_id"].dataType.simpleString() == "int" else pa.int64()

    def run(batches):
        ids, held, hashes, lengths, n = [], [], [], [], 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            found, ends = _tokens(batch.column("text").to_pylist())
            ids += doc_ids
            held += [fold_of(i, parts) == 0 for i in doc_ids]
            hashes.append(found)
            lengths += np.diff(np.concatenate([[0], ends])).tolist()
            n += len(found)
            if n >= BLOCK_TOKENS:
                yield pack(ids, held, hashes, lengths)
                ids, held, hashes, lengths, n = [], [], [], [], 0
        if ids:
            yield pack(ids, held, hashes, lengths)

    schema = BLOCKS.format(id=docs.schema["doc_id"].dataType.simpleString())
    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), "lm-blocks")


class Block:
    """One block's words and bigrams with its own training counts."""

    def __init__(self, words: bytes, tokens: bytes, ends: list, held: list):
        self.words = ascending(words)
        self.tokens = from_planes(tokens, 4).astype(np.int64)
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        train = ~np.array(held, bool)
        weight = np.repeat(train, self.ends - self.starts).astype(np.float64)
        self.own = np.bincount(self.tokens, weight, len(self.words)).astype(np.int64)
        after = np.ones(len(self.tokens), bool)
        after[self.starts] = False  # a text's first word has no history
        self.after = np.flatnonzero(after)
        pair = self.tokens[self.after - 1] * len(self.words) + self.tokens[self.after]
        self.pairs, self.arc = np.unique(pair, return_inverse=True)
        self.own_pairs = np.bincount(self.arc, weight[self.after], len(self.pairs)).astype(np.int64)
        self.first = self.pairs // max(1, len(self.words))
        self.second = self.words[self.pairs % max(1, len(self.words))] & FOLLOWER

    def ranges(self, n: int) -> np.ndarray:
        """Where each of the n hash ranges starts among the words."""
        part = range_of(self.words, n)
        return np.searchsorted(part, np.arange(n + 1))

    def hot(self, hot: np.ndarray) -> np.ndarray:
        """The number of each word among the hot ones (ascending), or -1."""
        at = np.searchsorted(hot, self.words)
        return np.where(np.isin(self.words, hot), at, -1)

    def deal(self, hot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which bigrams go to the n ranges (in each, those of hot
        words last), and where each range's bigrams and its hot ones start."""
        spread = self.hot(hot)[self.first] >= 0
        first = self.words[self.first]
        part = np.where(spread, range_of(mixed(first, self.second), n), range_of(first, n))
        order = np.lexsort((spread, part))
        key = (part.astype(np.int64) * 2 + spread)[order]
        return order, np.searchsorted(key, 2 * np.arange(n + 1)), np.searchsorted(key, 2 * np.arange(n) + 1)


def range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of a bigram."""
    h = (first ^ second * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)


def planes(values: np.ndarray, width: int) -> bytes:
    """Integers as byte planes, compressed: high bytes are mostly zero."""
    data = np.ascontiguousarray(
        values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def from_planes(data: bytes, width: int) -> np.ndarray:
    plain = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    part = np.frombuffer(plain, np.uint8).reshape(width, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :width] = part.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def ascending(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, 8), dtype=np.uint64)


def steps(values: np.ndarray) -> bytes:
    """Ascending 64-bit integers by their differences."""
    return planes(np.diff(values, prepend=np.uint64(0)), 8)


def hot_words(cut: DataFrame, n_blocks: int, most: int) -> np.ndarray:
    """Words with ``most`` or more bigrams, counted in each block that has its share
    of them; any other word has under twice as many. One per ``most`` tokens at most."""
    least = max(1, most // max(1, n_blocks))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["words"], row["tokens"], row["ends"], row["held"])
                follow = np.bincount(block.first, minlength=len(block.words))
                at = np.flatnonzero(follow >= least)
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array(block.words[at].view(np.int64)), "n": pa.array(follow[at])})

    rows = cut.select("words", "tokens", "ends", "held").mapInArrow(run, "word long, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= most).collect()
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def _send(n: int, hot: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["words"], row["tokens"], row["ends"], row["held"])
                cuts = block.ranges(n)
                order, pair_cuts, hot_cuts = block.deal(hot, n)
                number = block.hot(hot)
                follow = np.bincount(block.first, minlength=len(block.words))
                follow[number >= 0] = 0
                second, own_pairs = block.second[order], block.own_pairs[order]
                first = number[block.first][order]
                for p in range(n):
                    a, b, c, d = cuts[p], cuts[p + 1], pair_cuts[p], pair_cuts[p + 1]
                    if a == b and c == d:
                        continue
                    hots, hot_follow = np.unique(first[hot_cuts[p]:d], return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([p], pa.int32()), "block": [row["block"]],
                        "words": pa.array([steps(block.words[a:b])], pa.binary()),
                        "counts": pa.array([planes(block.own[a:b], 4)], pa.binary()),
                        "followers": pa.array([planes(follow[a:b], 4)], pa.binary()),
                        "seconds": pa.array([planes(second[c:d], 6)], pa.binary()),
                        "pair_counts": pa.array([planes(own_pairs[c:d], 4)], pa.binary()),
                        "hot": pa.array([steps(hots.astype(np.uint64))], pa.binary()),
                        "hot_followers": pa.array([planes(hot_follow, 4)], pa.binary())})
    return run


SENT = ("part int, block string, words binary, counts binary, followers binary, "
        "seconds binary, pair_counts binary, hot binary, hot_followers binary")
BACK = ("block string, part int, counts binary, kinds binary, pair_counts binary, "
        "n_train long, n_kinds long, hot array<long>, hot_kinds array<long>")


def _sum(group: pa.Table) -> pa.Table:
    """One hash range: training counts over all blocks, back to each block."""
    rows = group.to_pylist()
    words = [ascending(r["words"]) for r in rows]
    counts = [from_planes(r["counts"], 4).astype(np.int64) for r in rows]
    known, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(known)).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    mine = np.split(at, ends[:-1])
    # Of each row first the range's own words, then hot words, numbered after them.
    firsts = np.concatenate([np.repeat(
        np.concatenate([m, ascending(r["hot"]).astype(np.int64) + len(known)]),
        np.concatenate([from_planes(r[c], 4) for c in ("followers", "hot_followers")]).astype(np.int64))
        for m, r in zip(mine, rows)])
    seconds = np.concatenate([from_planes(r["seconds"], 6) for r in rows])
    pair_counts = [from_planes(r["pair_counts"], 4).astype(np.int64) for r in rows]
    order = np.lexsort((seconds, firsts))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(firsts[order]) != 0) | (seconds[order][1:] != seconds[order][:-1])
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    pair_total = np.bincount(pair, np.concatenate(pair_counts),
                             int(new.sum())).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    # Distinct followers in training: the Witten-Bell weight of a state.
    state = firsts[order][new]
    state, state_kinds = np.unique(state[pair_total > 0], return_counts=True)
    own = np.searchsorted(state, len(known))
    kinds = np.zeros(len(known), np.int64)
    kinds[state[:own]] = state_kinds[:own]
    pair_ends = np.cumsum([len(c) for c in pair_counts])
    pairs = np.split(pair, pair_ends[:-1])
    return pa.Table.from_pydict({
        "block": [r["block"] for r in rows], "part": pa.array([r["part"] for r in rows], pa.int32()),
        "counts": pa.array([planes(total[m] - c, 8) for m, c in zip(mine, counts)], pa.binary()),
        "kinds": pa.array([planes(kinds[m], 8) for m in mine], pa.binary()),
        "pair_counts": pa.array([planes(pair_total[m] - c, 8) for m, c in zip(pairs, pair_counts)],
                                pa.binary()),
        # Once per range, on its first row.
        "n_train": [int(total.sum()) if i == 0 else 0 for i in range(len(rows))],
        "n_kinds": [int((total > 0).sum()) if i == 0 else 0 for i in range(len(rows))],
        "hot": pa.array([(state[own:] - len(known)).tolist() if i == 0 else [] for i in range(len(rows))],
                        pa.list_(pa.int64())),
        "hot_kinds": pa.array([state_kinds[own:].tolist() if i == 0 else [] for i in range(len(rows))],
                              pa.list_(pa.int64()))})


def traverse(block: Block, counts: np.ndarray, kinds: np.ndarray, pair_counts: np.ndarray,
             n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, step): log10 of the root's arc for each token, and of the step the
    automaton takes there from the state of the token before."""
    root_arcs = np.log10((counts + ADDED) / (n + ADDED * (v + 1)))
    root = root_arcs[block.tokens]
    step = root.copy()
    if len(block.after):
        state = block.first
        word = block.pairs % len(block.words)
        known = counts[state] > 0
        total = np.maximum(1, counts[state] + kinds[state]).astype(np.float64)
        failure = np.where(known, np.log10(np.maximum(1e-300, kinds[state] / total)), 0.0)
        arc = np.log10(np.maximum(1e-300, (pair_counts + kinds[state] * 10.0 ** root_arcs[word]) / total))
        # An arc where training has one; else the failure arc and the root's.
        weight = np.where(pair_counts > 0, arc, failure + root_arcs[word])
        step[block.after] = weight[block.arc]
    return root, step


def score(docs: DataFrame, parts: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per
    document; trained on the documents whose id's crc32 mod ``parts`` is not 0.

    Null texts count as empty: one end token. Texts of any length are one run of
    tokens; equal rows are scored alike, and all count in training; without
    training documents every step is the root's. A task holds one block of
    documents or one hash range of words and of hot words' bigrams, both of
    bounded size.
    """
    cut = blocks(docs, parts)
    total, n_blocks = cut.agg(F.sum("n_tokens"), F.count("*")).first()
    total = total or 0
    n = int(max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // RANGE_TOKENS)))
    hot = hot_words(cut, n_blocks, max(1, RANGE_TOKENS // 8))
    sent = cut.select("block", "words", "tokens", "ends", "held").mapInArrow(_send(n, hot), SENT)
    back = stored(sent.groupBy("part").applyInArrow(_sum, BACK), "lm-counts")
    sizes = back.agg(F.sum("n_train"), F.sum("n_kinds")).first()
    n_train, n_kinds = sizes[0] or 0, sizes[1] or 0
    hot_kinds = np.zeros(len(hot), np.int64)
    for r in back.select(F.explode(F.arrays_zip("hot", "hot_kinds")).alias("x")) \
            .groupBy("x.hot").agg(F.sum("x.hot_kinds").alias("kinds")).collect():
        hot_kinds[r["hot"]] = r["kinds"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0]
        block = Block(row["words"], row["tokens"], row["ends"], row["held"])
        replies = sorted(right.to_pylist(), key=lambda r: r["part"])
        joined = lambda c: np.concatenate([from_planes(r[c], 8) for r in replies]).astype(np.int64)
        counts = block.own + joined("counts")
        kinds, number = joined("kinds"), block.hot(hot)
        kinds[number >= 0] = hot_kinds[number[number >= 0]]
        pair_counts = block.own_pairs.copy()
        pair_counts[block.deal(hot, n)[0]] += joined("pair_counts")
        root, step = traverse(block, counts, kinds, pair_counts, n_train, n_kinds)
        known = (counts[block.tokens] > 0).astype(np.int64)
        add = lambda x: np.add.reduceat(x, block.starts)
        size = block.ends - block.starts
        return pa.Table.from_pydict({
            "doc_id": left.column("doc_ids").combine_chunks().flatten(), "held_out": row["held"],
            "n_tokens": size, "n_known": add(known), "train_tokens": np.full(len(size), n_train),
            "base_score": add(root), "score": add(step)})

    return cut.groupBy("block").cogroup(
        back.select("block", "part", "counts", "kinds", "pair_counts").groupBy("block")) \
        .applyInArrow(run, schema)
