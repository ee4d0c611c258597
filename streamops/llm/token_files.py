"""Token ids as Arrow stream files of equal-length sequences with masks.

Documents are dealt to shards by range of id and sorted in each, so the shards
in order hold the ids of the whole corpus in order. A shard is one file: batches
of ``ids`` (fixed-size list of uint16, uint32 for vocabularies past 65,536) and
``mask`` (fixed-size list of bits, unset behind the shard's last id). Sequence and batch lengths are fixed, so any
sequence is found by arithmetic and read from a memory map without a copy.
Beside it lies the shard's index, one row per document.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamops.llm.chunks import ChunkEncoder, Tokenizer, byte_chars

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE, PER_BATCH, END_ID = 2048, 256, 2
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, ids_file string, index_file string, n_docs long, n_ids long"


@functools.lru_cache(maxsize=1)
def _encoder(digest: str, spec: Broadcast) -> ChunkEncoder:
    tokenizer = Tokenizer.from_str(spec.value)
    tokenizer.encode_special_tokens = True  # a text's own words are never special
    back = {chr(char): byte for byte, char in byte_chars().items()}
    bytes_of = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        bytes_of[i] = bytes(back[c] for c in token)
    return ChunkEncoder(tokenizer, bytes_of, entries=500_000)


def file_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes full batches of them."""

    def __init__(self, sink, length: int, per_batch: int, kind: np.dtype):
        self.length, self.per_batch, self.kind = length, per_batch, kind
        self.schema = file_schema(length, pa.from_numpy_dtype(kind))
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.kind, copy=False))
        self.n_waiting += len(ids)
        self.total += len(ids)
        full = self.length * self.per_batch
        if self.n_waiting >= full:
            data = np.concatenate(self.waiting)
            cut = len(data) // full * full
            for at in range(0, cut, full):
                self._write(data[at:at + full], full)
            self.waiting, self.n_waiting = [data[cut:]], len(data) - cut

    def _write(self, data: np.ndarray, real: int) -> None:
        mask = np.zeros(len(data), bool)
        mask[:real] = True
        self.writer.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(data), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.n_waiting:
            data = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(data) // self.length) * self.length, self.kind)
            padded[:len(data)] = data
            self._write(padded, len(data))
        self.writer.close()


def write(docs: DataFrame, folder: str, tokenizer_path: str, length: int = SEQUENCE,
          per_batch: int = PER_BATCH, end_id: int = END_ID) -> DataFrame:
    """Write the files below ``folder`` (one that all executors share) and return
    the stored manifest: shard, ids_file, index_file, n_docs, n_ids.

    Documents are ordered by doc_id, nulls first, equal ids by a hash of the text; a null text
    counts as empty, so every document has at least its end id. A task writes
    under a name of its own and renames at the end, so a lost executor or a
    second attempt leaves no half file behind. Memory per task: a batch of texts
    and one batch of sequences.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(text)
    digest = f"{zlib.crc32(text.encode())}"
    place, base = fs.FileSystem.from_uri(folder) if "://" in folder else (None, folder)
    del place

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        files = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
        files.create_dir(base, recursive=True)
        own = f"{base}/part-{shard:05d}-{uuid.uuid4().hex}"
        encoder = _encoder(digest, spec)
        kind = np.dtype(np.uint16 if len(encoder.lengths) <= 1 << 16 else np.uint32)
        end = np.array([end_id], kind)
        sink = index_sink = None
        n_docs = 0
        for batch in batches:
            if sink is None:
                sink = files.open_output_stream(f"{own}.ids.tmp")
                index_sink = files.open_output_stream(f"{own}.index.tmp")
                out = SequenceWriter(sink, length, per_batch, kind)
                index = pa.ipc.new_stream(index_sink, INDEX)
            starts = []
            for ids in encoder.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                starts.append(out.total)
                out.add(np.frombuffer(ids, "<u4"))
                out.add(end)
            starts = np.array(starts, np.int64)
            index.write_batch(pa.record_batch([
                batch.column("doc_id").cast(pa.int64()), pa.array(starts),
                pa.array(np.diff(np.append(starts, out.total)))], schema=INDEX))
            n_docs += len(starts)
        if sink is None:
            return
        out.close()
        index.close()
        for f in (sink, index_sink):
            f.close()
        for kind in ("ids", "index"):
            files.move(f"{own}.{kind}.tmp", f"{own}.{kind}.arrows")
        name = os.path.basename(own)
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "ids_file": [f"{name}.ids.arrows"],
            "index_file": [f"{name}.index.arrows"], "n_docs": [n_docs], "n_ids": [out.total]})

    # The ranges' bounds are sampled to the driver: a hash stands in for the text.
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")) \
        .repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text") \
        .select("doc_id", "text")
    manifest = ordered.mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class SequenceFile:
    """Random access to one ids file; on a local path through a memory map."""

    def __init__(self, files: fs.FileSystem, path: str):
        source = (pa.memory_map(path) if isinstance(files, fs.LocalFileSystem)
                  else files.open_input_file(path))
        reader = pa.ipc.open_stream(source)
        self.length = reader.schema.field("ids").type.list_size
        self.batches = list(reader)  # views of the map, no copies
        self.per_batch = len(self.batches[0]) * self.length if self.batches else 1

    def sequence(self, n: int) -> tuple[np.ndarray, pa.Array]:
        """The n-th sequence and its mask, both views of the file."""
        batch, at = divmod(n, self.per_batch // self.length)
        span = slice(at * self.length, (at + 1) * self.length)
        return self._ids(batch)[span], self.batches[batch].column("mask").flatten()[span]

    def _ids(self, batch: int) -> np.ndarray:
        return self.batches[batch].column("ids").flatten().to_numpy(zero_copy_only=True)

    def ids(self, start: int, count: int) -> list[np.ndarray]:
        """Views of ``count`` ids from ``start``, one per batch they lie in."""
        found = []
        while count > 0:
            batch, at = divmod(start, self.per_batch)
            piece = self._ids(batch)[at:at + count]
            found.append(piece)
            start, count = start + len(piece), count - len(piece)
        return found


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids before it in the
    corpus), n_tokens and ids_crc32 of its ids as stored.

    One file's memory map per task; the manifest has one row per shard and is the
    only thing summed over in one place.
    """
    from pyspark.sql import Window

    base = fs.FileSystem.from_uri(folder)[1] if "://" in folder else folder
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches):
        files = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
        for batch in batches:
            for row in batch.to_pylist():
                data = SequenceFile(files, f"{base}/{row['ids_file']}")
                with files.open_input_file(f"{base}/{row['index_file']}") as source:
                    for part in pa.ipc.open_stream(source):
                        crcs = []
                        for start, n in zip(part["start"].to_pylist(), part["n_tokens"].to_pylist()):
                            crc = 0
                            for piece in data.ids(start, n):
                                crc = zlib.crc32(piece.astype("<u4"), crc)
                            crcs.append(crc)
                        starts = part["start"].to_numpy() + row["base"]
                        yield pa.RecordBatch.from_arrays(
                            [part["doc_id"], pa.array(starts), part["n_tokens"],
                             pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A task per shard as far as the cluster has room for: shards are few.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(tasks, "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
