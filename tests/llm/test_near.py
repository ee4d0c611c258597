"""Near-duplicate texts and vectors against all pairs."""

import collections
import math
import random

import numpy as np
import pytest

from streamops.llm import dart_minhash, graph, itq
from streamops.llm.graph import components, forest, group_pairs


def smallest_reachable(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("small", [0, 200_000])
def test_components_of_chains_and_stars(spark, corpus, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL_GRAPH", small)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    random.Random(2).shuffle(links)
    got = {r.node: r.component for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == smallest_reachable({n for link in links for n in link if link[0] != link[1]}, links)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_forest_and_pairs():
    a, b = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 3), (1, 5), (8, 9)]
    group, side = np.array([0, 0, 0, 1, 1, 2]), np.array([0, 1, 1, 0, 0, 0])
    pairs = {(i, j) for left, right in group_pairs(group, side) for i, j in zip(left, right)}
    assert pairs == {(0, 1), (0, 2), (3, 4)}


def words_of(text):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(lower))


def shingled(text):
    words = words_of(text)
    n = min(5, len(words))
    return collections.Counter(tuple(words[k:k + n]) for k in range(len(words) - n + 1)) if words else {}


def near_texts():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 200]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    hot = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(60):
        copy = list(hot)
        copy[i] = "changed"
        texts.append(" ".join(copy))
    return texts + [None, None, "", "", "!!!", "word", "word", texts[0], texts[0]]


def test_near_texts_equal_all_pairs(corpus):
    texts = near_texts()
    docs = corpus([(i + 10, t) for i, t in enumerate(texts)] + [(None, None)])
    sets = {i + 10: shingled(t) for i, t in enumerate(texts) if t is not None}
    ids = [i + 10 for i in range(len(texts))]
    links = []
    for a in ids:
        for b in ids:
            if a < b and a in sets and b in sets:
                x, y = sets[a], sets[b]
                both = sum((collections.Counter(x) & collections.Counter(y)).values())
                either = sum((collections.Counter(x) | collections.Counter(y)).values())
                if texts[a - 10] == texts[b - 10] or (either and both / either >= 0.8):
                    links.append((a, b))
    rows = dart_minhash.near_duplicates(docs).collect()
    got = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == len(texts) + 1 and got.pop(None) is None
    assert got == smallest_reachable(ids, links)


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 600).astype(np.uint64)
    other = np.concatenate([base[:480], rng.integers(0, 1 << 62, 120).astype(np.uint64)])
    heavy = np.concatenate([base, base[:300]])  # weight 2 for half of it
    owner = np.repeat([0, 1, 2], [len(base), len(other), len(heavy)])
    got = dart_minhash.signatures(np.concatenate([base, other, heavy]), owner, 3)
    assert abs((got[0] == got[1]).mean() - 480 / 720) < 0.15
    assert abs((got[0] == got[2]).mean() - 600 / 900) < 0.15


def test_no_texts(corpus):
    assert dart_minhash.near_duplicates(corpus([])).collect() == []
    alone = dart_minhash.near_duplicates(corpus([(1, None), (2, "")])).collect()
    assert {r.doc_id: r.component_id for r in alone} == {1: 1, 2: 2}


@pytest.mark.parametrize("copies", [1, 5])
def test_vectors_equal_all_pairs(spark, corpus, copies):
    rng = np.random.default_rng(8)
    rows = []
    for centre in rng.normal(size=(20, 16)):
        for spread in (0.0, 0.02, 0.05, 0.08, 0.3):
            rows += [(centre + rng.normal(size=16) * spread).tolist()] * copies
    dense = rng.normal(size=16)
    rows += [(dense + rng.normal(size=16) * 0.02).tolist() for _ in range(300)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15,
           [float("inf")] + [1.0] * 15, [1e-200] * 16, [1e200] * 16, [1.0] * 8]
    table = list(enumerate(rows + odd))
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_duplicates(
        spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()}
    good = {i: np.array(v) / np.abs(v).max() for i, v in table
            if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = [(a, b) for a in good for b in good
             if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    count = collections.Counter(a for a, _ in links)
    label = smallest_reachable([i for i, _ in table], links)
    missed = sum(abs(got[i][0] - count[i]) for i, _ in table)
    assert missed <= 0.002 * len(links)
    assert all(got[i][0] <= count[i] for i, _ in table)
    assert {i: g[1] for i, g in got.items()} == label


@pytest.mark.parametrize("mean", [0.0, 0.7, 0.9, 0.97])
@pytest.mark.parametrize("n", [6_000, 1_000_000])
def test_codes_find_pairs_about_any_common_direction(mean, n):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    common = unit(rng.normal(size=64)) * mean / math.sqrt(1 - mean * mean)
    x = unit(common + unit(rng.normal(size=(2000, 64))))
    away = rng.normal(size=x.shape)
    away = unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    y = 0.955 * x + math.sqrt(1 - 0.955 ** 2) * away
    codes = itq.Codes(np.concatenate([x, y]), n)
    differ = codes.encode(x) ^ codes.encode(y)
    found = (differ == 0).any(axis=1) & (np.bitwise_count(differ).sum(axis=1) <= codes.most)
    assert found.mean() >= 0.999


def test_vectors_of_several_lengths_are_indexed_whole(spark, corpus):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(400, 16)).tolist()
    for base in rng.normal(size=(40, 256)):
        base[:16] *= 0.2  # what the pair differs in most relative to its size
        other = base.copy()
        other[:16] *= -1
        rows += [base.tolist(), other.tolist()]
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(spark.createDataFrame(
        list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(400, len(rows))] == [1] * 80


def test_no_vectors(spark, corpus):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert itq.near_duplicates(empty).collect() == []
