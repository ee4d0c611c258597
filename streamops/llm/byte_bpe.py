"""Byte-level BPE encoding and decoding with offsets.

The ranks of a byte-level vocabulary become a tokenizers.Tokenizer: every way to
cut a token into two known tokens is a merge, in the order of the ranks, so the
library merges as a rank-driven encoder does. Bytes are mapped to printable
characters for the library and back by the same table when decoding.
"""

from __future__ import annotations

import base64
import codecs
import functools

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.llm.chunks import ChunkEncoder, Tokenizer, byte_chars, pre_tokenizers

RANKS = "byte_bpe_multi_50k.tiktoken"


class ByteCodec:
    """Text to ids and back for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Regex, models

        chars = byte_chars()
        shown = {token: "".join(chr(chars[b]) for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            for cut in range(1, len(token)):
                left, right = token[:cut], token[cut:]
                if left in ranks and right in ranks:
                    merges.append((shown[left], shown[right]))
        tokenizer = Tokenizer(models.BPE(
            vocab={shown[t]: i for t, i in ranks.items()}, merges=merges, ignore_merges=True))
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.encoder = ChunkEncoder(tokenizer, self.bytes_of)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4") for ids in self.encoder.encode_all(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, int]:
        """The character each token starts in, and how many tokens start inside
        one (a character whose bytes are split over tokens)."""
        if not len(ids):
            return np.zeros(0, np.int32), 0
        starts = np.cumsum(self.encoder.lengths[ids]) - self.encoder.lengths[ids]
        first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        return (np.cumsum(first)[starts] - 1).astype(np.int32), int((~first[starts]).sum())

    def pieces(self, ids) -> list[str]:
        """One text per token; a split character comes out whole with its last byte."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        ids = list(ids)
        return [decoder.decode(self.bytes_of[i], final=k + 1 == len(ids))
                for k, i in enumerate(ids)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def _codec(ranks_id: int, ranks: Broadcast, pattern: str) -> ByteCodec:
    return ByteCodec(ranks.value, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str,
                  offsets: bool = False, keep_text: bool = True) -> DataFrame:
    """Each document's ids and the bytes they decode to.

    Returns the columns of ``docs`` (``text`` where ``keep_text``) other than those
    named here, with ``ids``
    (array<int>), ``decoded`` (binary), ``n_split`` (tokens that start inside a
    character) and, where asked for, ``offsets`` (array<int>, the character each
    token starts in). The vocabulary is read on the driver (its size is fixed)
    and broadcast. A null text counts as empty and gives no ids; texts of any
    length are encoded whole, in slices at places no match crosses; equal rows
    give equal rows.
    """
    spark = docs.sparkSession
    fresh = ["ids", "decoded", "n_split"] + ["offsets"] * offsets
    kept = [c for c in docs.columns if c.lower() not in fresh]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    back = [c for c in kept if keep_text or c != "text"]
    key = hash((ranks_path, pattern))
    types = {"ids": pa.list_(pa.int32()), "decoded": pa.large_binary(), "n_split": pa.int64(),
             "offsets": pa.list_(pa.int32())}

    def run(batches):
        codec = _codec(key, ranks, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = codec.encode(texts)
            data = [codec.decode(i) for i in ids]
            spans = [codec.offsets(i, d) for i, d in zip(ids, data)]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            listed = lambda parts: pa.ListArray.from_arrays(
                pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32)))
            out = {"ids": listed(ids) if ids else pa.array([], types["ids"]),
                   "decoded": pa.array(data, pa.binary()),
                   "n_split": pa.array([n for _, n in spans], pa.int64())}
            if offsets:
                out["offsets"] = (listed([s for s, _ in spans]) if ids
                                  else pa.array([], types["offsets"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in back] + list(out.values()), names=back + list(out))

    schema = T.StructType([frame.schema[c] for c in back] + [
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType()),
        T.StructField("n_split", T.LongType())] + (
        [T.StructField("offsets", T.ArrayType(T.IntegerType()))] if offsets else []))
    return frame.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and hashes of what ``encode_decode`` returned."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")
