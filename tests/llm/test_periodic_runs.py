"""Periodic runs against a plain search of every lag."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from streamops.llm import periodic_runs


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length, part = i - s + q, words[s:i + q]
            least = next(d for d in range(1, q + 1) if part[d:] == part[:length - d])
            if length >= max(6, 4 * q) and least == q:
                out.append((s, length, q))
    return sorted(out)


repeats = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 6)),
                   max_size=6).map(lambda parts: [w for p, n in parts for w in p * n])


@settings(max_examples=200, deadline=None)
@given(st.lists(repeats, min_size=1, max_size=4))
def test_runs_equal_a_plain_search(docs):
    ends = np.cumsum([len(d) for d in docs])
    found = periodic_runs.runs(np.array([w for d in docs for w in d], np.int64), ends)
    base = [0, *ends[:-1].tolist()]
    assert [tuple(r) for r in found.tolist()] == sorted(
        (s + b, n, q) for d, b in zip(docs, base) for s, n, q in plain_runs(d))


def test_one_word_many_times_is_one_run_in_near_linear_time():
    found = periodic_runs.runs(np.zeros(200_000, np.int64), np.array([200_000]))
    assert found.tolist() == [[0, 200_000, 1]]


def test_split_by_ascii_space_only():
    texts = [b"a b  a\n", None, b"", b" \t", "é\u0085b \u00a0".encode(), b"a"]
    for part in (texts, texts[3:]):
        found = periodic_runs.split(pa.array(texts, pa.binary()).slice(len(texts) - len(part)))
        words = [re.findall(rb"[^\x20\x09-\x0D]+", t or b"") for t in part]
        assert found.ends.tolist() == np.cumsum([len(w) for w in words]).tolist()
        assert [v.as_py() for v in found.values] == [w for ws in words for w in ws]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    named = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    text = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, n, len(runs), *named, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(), text.encode())


def test_query_equals_a_plain_search(spark, corpus):
    rnd = random.Random(7)
    rows = [(k, " ".join(rnd.choice("ab") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 60)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "a a a a a a a"), (203, "x y " * 50), (203, "x y " * 50),
             (204, "lang text lang text " * 700), (205, "w " * 7 + "ü ß " * 9)]
    docs = corpus(rows).withColumnRenamed("extra", "start").withColumnRenamed("source", "_hash")
    found = periodic_runs.find(docs, planted=True).collect()
    key = str
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found), key=key) == \
        sorted((expected(*r) for r in rows), key=key)
    assert periodic_runs.find(docs.limit(0)).count() == 0
    assert sum(r.n_runs for r in found) > 10
