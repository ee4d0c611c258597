"""Benchmark phrases against a scan of every window."""

import random

import pytest
from test_near import words_of

from streamops.llm import positional_index


def expected(text, items):
    words, hit, found = words_of(text or ""), set(), []
    for item_id, item in items:
        terms = words_of(item or "")
        n = min(10, len(terms))
        windows = {tuple(terms[k:k + n]) for k in range(len(terms) - n + 1)} if terms else set()
        at = [k for k in range(len(words) - n + 1) if n and tuple(words[k:k + n]) in windows]
        for k in at:
            hit.update(range(k, k + n))
        if at:
            found.append("" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(set(found))


def test_phrases_equal_a_scan(spark, corpus):
    rng = random.Random(6)
    vocabulary = ["the", "of", "Und"] * 8 + [f"t{i}" for i in range(60)] + ["é", "日本"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n)))
             for i, n in enumerate([40, 25, 12, 10, 9, 4, 1, 30])]
    items += [(50, None), (51, ""), (52, "!!!"), (None, "only one nameless item here now"), (None, "t1 t2"), (3, "the of the of"),
              (60, "same id"), (60, "id same")]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 80, 300]))]
        for _ in range(rng.randint(0, 3)):
            source = (rng.choice(items)[1] or "x").split() or ["x"]
            a = rng.randrange(len(source))
            words[rng.randint(0, len(words)):0] = source[a:a + rng.randint(1, 30)]
        texts.append(" ".join(words))
    texts += [None, "", texts[5], texts[5], (items[0][1] + " ") * 50, "same id id same only one nameless item here now t1 t2"]
    docs = corpus(list(enumerate(texts))).withColumnRenamed("extra", "items")
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string")
    rows = positional_index.contamination(docs, bench).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in rows}
    assert got == {i: expected(t, items) for i, t in enumerate(texts)}
    assert sum(g[1] > 0 for g in got.values()) > 10
    none = positional_index.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.n_hit for r in none)
    assert positional_index.contamination(docs.limit(0), bench).collect() == []


def test_proximity_finds_moved_words(spark, corpus):
    item = " ".join(f"q{i}" for i in range(10))
    words = item.split()
    docs = corpus([(1, " ".join(words[:5] + ["between"] * 2 + words[5:])), (2, "nothing alike")])
    items = positional_index.item_terms(spark.createDataFrame([(1, item)], "item_id long, text string"))
    terms = items.selectExpr("explode(terms) as term").distinct()
    planned = positional_index.plan(items, positional_index.term_counts(docs, terms), anchors=10)
    index = positional_index.build_index(docs, terms)
    assert positional_index.intersect(index, planned).count() == 0
    near = positional_index.proximity(index, planned, slop=8, least=8).collect()
    assert near and all(r.n_terms >= 8 for r in near)


@pytest.mark.parametrize("before", [0, 2, 3, 7])
def test_proximity_does_not_depend_on_the_place(spark, corpus, before):
    words = [f"q{i}" for i in range(10)]
    text = ["first"] * before + words[:5] + ["between"] * 5 + words[5:]
    docs = corpus([(1, " ".join(text))])
    items = positional_index.item_terms(
        spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    terms = items.selectExpr("explode(terms) as term").distinct()
    planned = positional_index.plan(items, positional_index.term_counts(docs, terms), anchors=10)
    index = positional_index.build_index(docs, terms)
    near = positional_index.proximity(index, planned, slop=8, least=10).collect()
    assert [(r.near, r.n_terms) for r in near] == [(before, 10)]
    assert positional_index.proximity(index, planned, slop=5, least=6).count() == 0
