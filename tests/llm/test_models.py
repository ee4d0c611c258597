"""Language, quality, language-model and personal-data operators."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from streamops.llm import backoff_lm, char_crf, rank_profiles, subword_quality

SYLLABLES = {"aa": "ka lo mi tu ra".split(), "bb": "sch ung heit ver ein".split(),
             "cc": "pré eau oui ette ille".split()}


def sentences(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return [" ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))
                     for _ in range(rng.randint(3, 60))) for _ in range(n)]


def test_languages_of_unseen_texts(spark, corpus):
    train = [(lang, t) for lang in SYLLABLES for t in sentences(lang, 40, 1)]
    train += [(None, "ka lo"), ("aa", None), ("aa", ""), ("zz", "123")]
    profiles = rank_profiles.learn(spark.createDataFrame(train, "lang string, text string"))
    asked = [(lang, t) for lang in SYLLABLES for t in sentences(lang, 30, 2)]
    texts = [t for _, t in asked] + [None, "", "123 !?", "ka lo mi " * 50_000]
    docs = corpus(list(enumerate(texts))).withColumnRenamed("extra", "score")
    got = {r.doc_id: r for r in rank_profiles.identify(docs, profiles).collect()}
    assert [got[i].lang_pred for i in range(len(asked))] == [lang for lang, _ in asked]
    assert [got[len(asked) + k].lang_pred for k in range(4)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = rank_profiles.identify(docs, profiles.limit(0)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_ngrams_equal_a_plain_count():
    texts = ["Das ist, ja!", "", "éßx  y9z"]
    keys, owner, alphabet = rank_profiles.ngrams(texts)
    grams = rank_profiles.packed(keys, alphabet)
    for i, text in enumerate(texts):
        clean = " " + re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
        plain = collections.Counter()
        for n in (1, 2, 3):
            for k in range(len(clean) - n + 1):
                gram = clean[k:k + n]
                if gram.strip() and (n < 3 or gram[1] != " "):
                    plain[gram] += 1
        got = collections.Counter()
        for g in grams[owner == i].tolist():
            text_of = ""
            for shift in (42, 21, 0):
                code = g >> shift & 0x1FFFFF
                text_of += chr(code) if code else ""
            got[text_of] += 1
        assert got == plain


def test_quality_of_unseen_texts(spark, corpus):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(160):
        clean = sentences("aa", 1, i)[0]
        bad = i % 4 == 0
        texts.append(" ".join(w + rng.choice(["###", "&&&", "!!"]) for w in clean.split()) if bad else clean)
        labels.append((i, 0 if bad else 1, 0))
    extra = [None, "", "ka " * 200_000]
    docs = corpus(list(enumerate(texts + extra)))
    table = spark.createDataFrame(labels + [(None, 1, 0), (999, None, 0), (1, 1, 0)],
                                  "doc_id long, quality int, toxic int")
    seen = subword_quality.training_labels(table)
    got = {r.doc_id: r.score for r in subword_quality.score(
        docs, subword_quality.train(docs, seen)).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 15
    assert np.mean([(got[i] >= 0.3) == labels[i][1] for i in held]) > 0.9
    assert all(0 <= s <= 1 for s in got.values())
    unknown = subword_quality.score(docs, subword_quality.train(docs, table.limit(0)))
    assert {round(r.score, 6) for r in unknown.collect()} == {0.5}


@pytest.mark.parametrize("text", ["stream", "привет", "こんにちは世", "a😀b😀c😀"])
def test_subwords_are_characters_in_any_script(text):
    buckets, ends = subword_quality.features([text])
    assert len(buckets) == ends[0] == 1 + (len(text) - 2) + (len(text) - 3)
    assert len(set(buckets.tolist())) == len(buckets)
    assert 0 <= buckets.min() and buckets.max() < subword_quality.BUCKETS


def plain_scores(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = {i: re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower)) + [None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in runs}
    c, pairs = collections.Counter(), collections.Counter()
    for i, run in runs.items():
        if not held[i]:
            c.update(run)
            pairs.update(zip(run, run[1:]))
    kinds, n, v = collections.Counter(a for a, _ in pairs), sum(c.values()), len(c)
    root = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    out = {}
    for i, run in runs.items():
        total, state = 0.0, None
        for at, word in enumerate(run):
            if at and pairs[state, word]:
                total += math.log10((pairs[state, word] + kinds[state] * root(word)) / (c[state] + kinds[state]))
            else:
                if at and c[state]:
                    total += math.log10(kinds[state] / (c[state] + kinds[state]))
                total += math.log10(root(word))
            state = word
        out[i] = (held[i], len(run), sum(c[w] > 0 for w in run), n,
                  sum(math.log10(root(w)) for w in run), total)
    return out


@pytest.mark.parametrize("block", [50, 3_000_000])
def test_automaton_equals_a_plain_traversal(corpus, monkeypatch, block):
    monkeypatch.setattr(backoff_lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(backoff_lm, "RANGE_TOKENS", 60)
    texts = sentences("aa", 25, 9) + sentences("cc", 15, 9) + [None, "", " \t ", "Ka KA ka", "　x y", "zz"]
    texts += [texts[0]] * 4
    docs = list(enumerate(texts))
    rows = backoff_lm.score(corpus(docs).repartition(3)).collect()
    assert len(rows) == len(docs)
    expected = plain_scores(docs)
    for r in rows:
        want = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(want[5], rel=1e-9, abs=1e-9)


def test_a_hot_first_word_spreads_over_the_ranges(corpus, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(backoff_lm, "RANGE_TOKENS", 400)
    kept, store = {}, backoff_lm.stored
    monkeypatch.setattr(backoff_lm, "stored", lambda df, name: kept.setdefault(name, store(df, name)))
    docs = [(i, " ".join(f"the w{i * 7 % 90 + j}" for j in range(50))) for i in range(100)]
    rows = backoff_lm.score(corpus(docs).repartition(20)).collect()
    expected = plain_scores(docs)
    for r in rows:
        assert r.score == pytest.approx(expected[r.doc_id][5], rel=1e-9, abs=1e-9)
    load = collections.Counter()
    for r in kept["lm-counts"].collect():
        load[r["part"]] += len(backoff_lm.from_planes(bytes(r["pair_counts"]), 8))
    assert max(load.values()) < 400 < sum(load.values())


def test_automaton_without_training(corpus):
    assert backoff_lm.score(corpus([])).collect() == []
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = backoff_lm.score(corpus([(held, "a b")])).collect()[0]
    assert (row.train_tokens, row.n_tokens, row.n_known) == (0, 3, 0) and row.score == row.base_score


RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 12 <= len(digits) <= 19 and char_crf.luhn(digits),
                  "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [(s, kind, e) for s, _, kind, e in sorted(out)]


def test_base_spans_equal_the_rules():
    rng = random.Random(12)
    parts = ["a", "x.y", "@", ".", "1", "255", "256", "4111 1111 1111 1111", "+49 (30) 1234-5678", " ", "-",
             "bob@mail.example.org", "10.0.0.1", "é", "+", "(", "00", "%"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert char_crf.base_spans(text) == plain_spans(text)


def pii_texts(n, seed):
    rng = random.Random(seed)
    words = "we met them near the old bridge and wrote to each other later".split()
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        spot = rng.choice([f"{rng.choice(words)}{rng.randint(1, 99)}@site{rng.randint(1, 9)}.example.com",
                           ".".join(str(rng.randint(0, 255)) for _ in range(4)),
                           f"+{rng.randint(10, 99)} {rng.randint(100, 999)} {rng.randint(1000000, 9999999)}",
                           str(rng.randint(1, 9999))])
        text.insert(rng.randint(0, len(text)), spot)
        out.append(" ".join(text))
    return out


def test_network_learns_the_labelled_spans(corpus):
    docs = corpus(list(enumerate(pii_texts(250, 1))))
    ids, tags = char_crf.labelled_windows(docs, 400)
    network = char_crf.Network()
    network.fit(ids, tags, epochs=8)
    seen = [(char_crf.char_ids(t), char_crf.tags_of(t, char_crf.base_spans(t)), t) for t in pii_texts(60, 2)]
    right = total = wrong = clean = 0
    for chars, marks, text in seen:
        for start in char_crf.window_starts(text):
            decoded = network.viterbi(network.emissions(char_crf._window(chars, start)[None].astype(int))[0])[0]
            want = marks[start:start + char_crf.WINDOW]
            got = decoded[:len(want)]
            right += int(((got > 0) & (want > 0)).sum())
            total += int((want > 0).sum())
            wrong += int(((got > 0) & (want == 0)).sum())
            clean += int((want == 0).sum())
    assert right / total > 0.8 and wrong / clean < 0.1


def test_gradient_equals_differences():
    network = char_crf.Network(1)
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, 120, (2, 6)), rng.integers(0, char_crf.TAGS, (2, 6))

    def loss():
        scores = network.emissions(ids)[0]
        total = network.marginals(scores)[1]
        path = np.take_along_axis(scores, tags[:, :, None], 2).sum()
        return total.sum() - path - network.p["t"][tags[:, :-1], tags[:, 1:]].sum()

    scores, both, fs, bs = network.emissions(ids)
    unary, _, joint = network.marginals(scores, pairs=True)
    d = unary.copy()
    np.put_along_axis(d, tags[:, :, None], np.take_along_axis(d, tags[:, :, None], 2) - 1, 2)
    grads = {k: np.zeros_like(v) for k, v in network.p.items()}
    dboth = d @ network.p["w"].T
    network._lstm_back(ids, "f", fs, dboth[:, :, :char_crf.HIDDEN], grads)
    network._lstm_back(ids[:, ::-1], "b", bs, dboth[:, ::-1, char_crf.HIDDEN:], grads)
    for name in ("hf", "hb", "bf", "bb"):
        at = np.unravel_index(5, network.p[name].shape)
        before, step = network.p[name][at], 1e-5
        network.p[name][at] = before + step
        high = loss()
        network.p[name][at] = before - step
        low = loss()
        network.p[name][at] = before
        assert grads[name][at] == pytest.approx((high - low) / (2 * step), rel=1e-4, abs=1e-7)


def test_personal_data_of_documents(corpus):
    texts = pii_texts(40, 3) + [None, "", "no digits", "a@b.co " * 3000, "é 10.0.0.1 é bob@x.org"]
    docs = corpus(list(enumerate(texts + texts[:1]))).withColumnRenamed("extra", "spans")
    network = char_crf.train(docs, 200)
    found = char_crf.find(docs, network)
    rows = {r.doc_id: r for r in found.collect()}
    for i, text in enumerate(texts):
        base = [(s["start"], s["kind"], s["end"]) for s in rows[i].base]
        spans = [(s["start"], s["kind"], s["end"]) for s in rows[i].spans]
        assert base == plain_spans(text or "")
        assert set(base) <= set(spans)
        added = sorted(set(spans) - set(base))
        assert all(e <= s or end <= start for start, _, end in added for s, _, e in base)
    redacted = {r.doc_id: r.text for r in char_crf.find(docs, network, redact=True).collect()}
    assert redacted[44] == "é <IP> é <EMAIL>" and redacted[40] is None and redacted[41] == ""
    assert char_crf.find(docs.limit(0), char_crf.train(docs.limit(0))).collect() == []
