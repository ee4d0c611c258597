"""URL verdicts: a blocked Bloom filter of listed keys in front of an exact hash join.

A list holds two kinds of keys: rules, a host with a path, which fit the host and
its subdomains where the path starts with theirs; and whole canonical URLs. A
URL has many keys that could be listed (each suffix of its host with each prefix
of its path, and itself), of which nearly all are not. The filter has one block
of 256 bits for a key, so a probe touches one cache line; what passes it meets
the list in an exact join, which removes the false positives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamops.llm.words import mix

ALLOW, BLOCK = "allow", "block"
WORDS = 4  # 64-bit words of a block
BITS_PER_KEY = 16
# The filter never outgrows this; a longer list passes more false positives to
# the join, which removes them as before.
MAX_FILTER_BYTES = 16 << 20
# A bit for each length, modulo this, that some rule's host or path has.
LENGTHS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Parameters that name a visit, not a page.
VISIT_PARAMETERS = r"^(utm_[a-z]+|ref)(=|$)"


def url_parts(url: str) -> dict[str, Column]:
    """``host`` and ``path`` of a URL; both empty without a ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    before = F.regexp_extract(rest, r"^([^?#]*)", 1)
    return {"host": F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit("")),
            "path": F.coalesce(F.regexp_extract(before, r"^[^/]*(/(?s:.*))", 1), F.lit(""))}


def canonical(url: str, host: str = "host", path: str = "path") -> Column:
    """The same text for addresses of one page: scheme, ``www.``, fragment, closing
    slash and parameters of the visit are dropped, other parameters sorted."""
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(VISIT_PARAMETERS)))
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+\z", ""),
                    F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&")))
                    .otherwise(F.lit("")))


def listing(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(key, rule, verdict): one row per listed key.

    ``rules`` has ``verdict`` and ``rule`` (host and path, such as ``net/``),
    ``urls`` the listed canonical URLs as ``url``, which are to be blocked. A rule
    listed with both verdicts blocks. Null entries and rules without a host are none.
    """
    host = F.translate(F.regexp_extract("rule", r"^([^/]*)", 1), _UPPER, _LOWER)
    key = F.concat(host, F.regexp_extract("rule", r"^[^/]*((?s:.*))", 1))
    ruled = rules.where((host != "") & F.col("verdict").isNotNull()).select(key.alias("rule"), "verdict") \
        .groupBy("rule").agg(F.max("verdict").alias("verdict"))
    whole = urls.where("url is not null").select("url").distinct()
    return ruled.select(F.col("rule").alias("key"), "rule", "verdict").unionByName(
        whole.select(F.concat(F.lit("="), "url").alias("key"), F.lit(None).cast("string").alias("rule"),
                     F.lit(BLOCK).alias("verdict")))


def places(keys: list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key its block and, as four words, its eight bits there."""
    first = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    eight = mix(first).view(np.uint8).reshape(len(keys), 8)
    mask = np.zeros((len(keys), WORDS), np.uint64)
    rows = np.arange(len(keys))
    for k in range(8):
        mask[rows, eight[:, k] >> 6] |= np.uint64(1) << (eight[:, k] & 63).astype(np.uint64)
    # The product's upper half maps the hash's upper half evenly onto the blocks.
    return ((first >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), mask


@dataclass
class Filter:
    words: np.ndarray
    hosts: np.ndarray
    paths: np.ndarray

    def passes(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        at, mask = places(keys, len(self.words))
        return (self.words[at] & mask == mask).all(axis=1)

    def candidates(self, host: bytes, path: bytes) -> list[bytes]:
        """Keys of rules that could fit: by their lengths some rule may be like that."""
        if not host:
            return []
        starts = [0]
        at = host.find(b".")
        while at >= 0:
            starts.append(at + 1)
            at = host.find(b".", at + 1)
        # A rule without a host would end the suffixes; there is none.
        suffixes = [host[s:] for s in starts if s < len(host) and self.hosts[(len(host) - s) % LENGTHS]]
        if not suffixes:
            return []
        lengths = np.flatnonzero(np.resize(self.paths, len(path) + 1)).tolist()
        return [s + path[:n] for s in suffixes for n in lengths]


def build(keys: DataFrame, bits_per_key: int = BITS_PER_KEY, most: int = MAX_FILTER_BYTES) -> Filter:
    """The filter of a list: tasks hash keys, bits of one block are joined before and
    after the shuffle, and at most ``most`` bytes come to the driver."""
    n = keys.count()
    blocks = max(1, min(most // (8 * WORDS), -(-n * bits_per_key // (64 * WORDS))))

    def hashed(batches):
        for batch in batches:
            at, mask = places([k.as_buffer().to_pybytes() for k in batch.column("key")], blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at)] + [pa.array(mask[:, w].view(np.int64)) for w in range(WORDS)],
                names=["at", *(f"w{w}" for w in range(WORDS))])

    schema = "at long, " + ", ".join(f"w{w} long" for w in range(WORDS))
    rows = keys.select(F.col("key").cast("binary").alias("key")).mapInArrow(hashed, schema) \
        .groupBy("at").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]).collect()
    words = np.zeros((blocks, WORDS), np.uint64)
    for row in rows:
        words[row["at"]] = np.array(row[1:], np.int64).view(np.uint64)

    def lengths(text: Column) -> np.ndarray:
        found = keys.where("rule is not null").select((F.octet_length(text) % LENGTHS).alias("n")).distinct()
        out = np.zeros(LENGTHS, bool)
        out[[r.n for r in found.collect()]] = True
        return out

    return Filter(words, lengths(F.regexp_extract("rule", r"^([^/]*)", 1)),
                  lengths(F.regexp_extract("rule", r"^[^/]*((?s:.*))", 1)))


def _probe(shared):
    def run(batches):
        for batch in batches:
            listed: Filter = shared.value
            keys, owner = [], []
            for k, (host, path, whole) in enumerate(zip(*(batch.column(c) for c in ("host", "path", "canonical")))):
                own = listed.candidates(host.as_py(), path.as_py()) + [b"=" + whole.as_py()]
                keys += own
                owner += [k] * len(own)
            hits = [[] for _ in range(batch.num_rows)]
            for at in np.flatnonzero(listed.passes(keys)).tolist():
                hits[owner[at]].append(keys[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("url"), pa.array(hits, pa.list_(pa.binary()))], names=["url", "hits"])
    return run


def free_name(taken: list[str], name: str) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def judge(pages: DataFrame, rules: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest rule that fits decides (of two as long the one of the longer
    host); without one a page is blocked if its canonical URL is listed, else
    allowed. A null URL, or one without ``://``, has an empty host and path, fits
    nothing and is allowed. Equal URLs get equal verdicts; each row is returned
    once. Columns of ``pages`` named like the four new ones are replaced, others
    stay as they are. An empty list allows everything.
    """
    spark = pages.sparkSession
    keys = listing(rules, urls)
    shared = spark.sparkContext.broadcast(build(keys))
    given = pages.drop("host", "path", "rule", "verdict").withColumns(url_parts(url))
    probed = given.where("host <> ''").select(
        F.col(url).alias("url"), F.col("host").cast("binary").alias("host"),
        F.col("path").cast("binary").alias("path"), canonical(url).cast("binary").alias("canonical")) \
        .mapInArrow(_probe(shared), "url string, hits array<binary>").where(F.size("hits") > 0)
    # One row per URL that has hits: copies of a hot URL collapse before the shuffle.
    hits = probed.groupBy("url").agg(F.first("hits").alias("hits")) \
        .select("url", F.explode("hits").alias("key")).withColumn("key", F.col("key").cast("string"))
    own, best = (free_name(given.columns, n) for n in ("own_url", "best"))
    better = F.struct(F.col("rule").isNotNull().alias("ruled"), F.octet_length("rule").alias("size"),
                      F.instr("rule", "/").alias("host_size"), "rule", "verdict")
    decided = hits.join(keys, "key").groupBy(F.col("url").alias(own)).agg(F.max(better).alias(best))
    return given.join(decided, F.col(url) == F.col(own), "left").select(
        *[F.col(f"`{c}`") for c in given.columns], F.col(f"{best}.rule").alias("rule"),
        F.coalesce(f"{best}.verdict", F.lit(ALLOW)).alias("verdict"))
