"""Byte-level BPE and token files against the libraries themselves."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from streamops.llm import byte_bpe, token_files
from streamops.llm.chunks import slices

RANKS = public_tokenizers.path(byte_bpe.RANKS)
EDGES = ["", " ", "\n", "a", "  two  spaces  ", "tabs\tand\r\nlines\n\n", "it's the dog's", "don't\n don't",
         "Ünïcödé wörds, und.\nÄpfel", "日本語 テキスト", "🙂🙂 mixed 🙂", "x" * 3000, "a.b,c. d , e",
         "1234567 89", "\0nul\0", "　wide space", "²³ ½", "<|endoftext|>", "é combining"]


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteCodec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "é", "the", " ", "  ", "\n", ".", ",", "'s", "\t", "1", "²", "　", "日本", "_", "-",
             "🙂", "\0", "\r\n", "aa", "=="]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_ids_equal_the_rank_encoder(codec, exact):
    texts = EDGES + random_texts(20_000, 1)
    codec.encoder.entries = 200  # forces the cache to turn over
    got = codec.encode(texts)
    assert [g.tolist() for g in got] == [exact.encode_ordinary(t) for t in texts]
    assert [codec.decode(g) for g in got] == [t.encode() for t in texts]
    assert ["".join(codec.pieces(g.tolist())) for g in got[:50]] == texts[:50]


def test_long_text_is_cut_only_where_matches_end(codec, exact, monkeypatch):
    text = "some words here, and more  of them.\n" * 400
    assert "".join(slices(text, 100)) == text and len(list(slices(text, 100))) > 50
    ids = [i for piece in slices(text, 100) for i in exact.encode_ordinary(piece)]
    assert ids == exact.encode_ordinary(text)


def test_offsets_point_at_characters(codec):
    text = "né 🙂 日"
    ids = codec.encode([text])[0]
    starts, split = codec.offsets(ids, text.encode())
    for start, i in zip(starts.tolist(), ids.tolist()):
        assert codec.bytes_of[i][:1] in text[start].encode() or split
    assert split == sum(codec.bytes_of[i][0] & 0xC0 == 0x80 for i in ids.tolist())


def test_documents(corpus, exact):
    texts = [None, *EDGES, EDGES[3]]
    docs = corpus(list(enumerate(texts))).withColumnRenamed("extra", "ids")
    rows = {r.doc_id: r for r in byte_bpe.encode_decode(
        docs, RANKS, public_tokenizers.PATTERN, offsets=True).collect()}
    for i, text in enumerate(texts):
        assert rows[i].ids == exact.encode_ordinary(text or "")
        assert bytes(rows[i].decoded) == (text or "").encode() and len(rows[i].offsets) == len(rows[i].ids)
    empty = byte_bpe.encode_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN)
    assert empty.collect() == []


def test_token_files(spark, corpus, folder):
    path = public_tokenizers.path(token_files.TOKENIZER)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = [None, *EDGES] + [" ".join(random_texts(40, 5))] * 3
    docs = corpus([(len(texts) - i, t) for i, t in enumerate(texts)])
    where = folder("tokens")
    manifest = token_files.write(docs, where, path, length=16, per_batch=4)
    rows = sorted(token_files.read(spark, where, manifest).collect())
    start = 0
    for row in rows:
        ids = library.encode(texts[len(texts) - row.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(rows) == len(texts) and sum(r.n_ids for r in manifest.collect()) == start


def test_sequences_are_views_with_masks(spark, corpus, folder):
    where = folder("tokens")
    docs = corpus([(1, "some words " * 30)]).coalesce(1)
    manifest = token_files.write(docs, where, public_tokenizers.path(token_files.TOKENIZER),
                                 length=16, per_batch=2).collect()[0]
    data = token_files.SequenceFile(pa.fs.LocalFileSystem(), f"{where}/{manifest.ids_file}")
    ids = np.concatenate(data.ids(0, manifest.n_ids))
    full, rest = divmod(manifest.n_ids, 16)
    for n in range(full):
        sequence, mask = data.sequence(n)
        assert sequence.tolist() == ids[16 * n:16 * n + 16].tolist() and all(mask.to_pylist())
        assert not sequence.flags.owndata
    _, mask = data.sequence(full)
    assert sum(mask.to_pylist()) == rest


def test_no_documents(spark, corpus, folder):
    where = folder("tokens")
    manifest = token_files.write(corpus([]), where, public_tokenizers.path(token_files.TOKENIZER))
    assert token_files.read(spark, where, manifest).collect() == []


def test_ranks_are_read_as_written():
    ranks = byte_bpe.read_ranks(RANKS)
    with open(RANKS, "rb") as lines:
        first = lines.readline().split()
    assert ranks[base64.b64decode(first[0])] == int(first[1])
