"""Personal data by rules and a character-level bidirectional LSTM with a CRF.

Rules give the base spans. The network is trained in numpy on windows of text
labelled with base spans and reads overlapping windows; a CRF over begin/inside
tags decodes each, and what the windows say is reconciled per document: a span
counts in the window whose middle it stands nearest to, base spans stay, and of
overlapping added ones the more certain wins.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LOCAL_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
# A match never starts inside a run of digits, so only their starts are tried.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")

WINDOW, STRIDE = 64, 32
SAMPLE, EPOCHS, BATCH, RATE = 1500, 6, 32, 0.02
HIDDEN, TAGS = 16, 1 + 2 * len(KINDS)
CERTAIN = 0.98
CHARS = 130


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    found = []
    if not TRIGGER.search(text):
        return found
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_BEFORE:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            done = match.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for match in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255
               for p in match.group().split(".")):
            found.append((match.start(), 1, match.end()))
    for match in CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((match.start(), 2, match.end()))
    for match in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in match.group()) <= 15:
            found.append((match.start(), 3, match.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def char_ids(text: str) -> np.ndarray:
    """ASCII as itself, other letters as one class, the rest as another."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(codes < 128, codes, 129).astype(np.int16)
    for i in np.flatnonzero(codes >= 128):
        if text[i].isalpha():
            out[i] = 128
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows with a digit or an @. A span of any kind has one, so
    the others hold nothing to find."""
    steps = {m.start() // STRIDE for m in TRIGGER.finditer(text)}
    return sorted({s * STRIDE for step in steps for s in (step - 1, step) if s >= 0})


def tags_of(text: str, spans: list[tuple[int, str, int]]) -> np.ndarray:
    tags = np.zeros(len(text), np.int8)
    for start, kind, end in spans:
        if not tags[start:end].any():
            tags[start:end] = 2 + 2 * KINDS.index(kind)
            tags[start] -= 1
    return tags


class Network:
    """Two LSTMs over character classes, a linear layer to tags, CRF transitions."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (CHARS + 1, 4 * h))
            self.p[f"h{d}"] = rng.normal(0, 0.2, (h, 4 * h))
            bias = np.zeros(4 * h)
            bias[h:2 * h] = 1.0
            self.p[f"b{d}"] = bias
        self.p["w"] = rng.normal(0, 0.3, (2 * h, TAGS))
        self.p["o"] = np.zeros(TAGS)
        self.p["t"] = rng.normal(0, 0.1, (TAGS, TAGS))

    def _lstm(self, ids: np.ndarray, d: str):
        h, n = HIDDEN, len(ids)
        x, rec = self.p[f"x{d}"][ids] + self.p[f"b{d}"], self.p[f"h{d}"]
        state, cell, steps = np.zeros((n, h)), np.zeros((n, h)), []
        out = np.zeros((n, ids.shape[1], h))
        for t in range(ids.shape[1]):
            z = x[:, t] + state @ rec
            gates = 1 / (1 + np.exp(-z[:, :3 * h]))
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            g = np.tanh(z[:, 3 * h:])
            old, before = cell, state
            cell = f * old + i * g
            tc = np.tanh(cell)
            state = o * tc
            out[:, t] = state
            steps.append((i, f, o, g, old, tc, before))
        return out, steps

    def _lstm_back(self, ids, d, steps, dout, grads):
        h = HIDDEN
        rec = self.p[f"h{d}"]
        dstate, dcell = np.zeros((len(ids), h)), np.zeros((len(ids), h))
        dz_all = np.zeros((len(ids), ids.shape[1], 4 * h))
        for t in range(ids.shape[1] - 1, -1, -1):
            i, f, o, g, old, tc, before = steps[t]
            ds = dout[:, t] + dstate
            dc = dcell + ds * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f),
                                 ds * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grads[f"h{d}"] += before.T @ dz
            dstate, dcell = dz @ rec.T, dc * f
            dz_all[:, t] = dz
        np.add.at(grads[f"x{d}"], ids, dz_all)
        grads[f"b{d}"] += dz_all.sum(axis=(0, 1))

    def emissions(self, ids: np.ndarray):
        forward, fs = self._lstm(ids, "f")
        backward, bs = self._lstm(ids[:, ::-1], "b")
        both = np.concatenate([forward, backward[:, ::-1]], axis=2)
        return both @ self.p["w"] + self.p["o"], both, fs, bs

    def marginals(self, scores: np.ndarray, pairs: bool = False):
        """Posterior of each tag at each place; with ``pairs`` of transitions too."""
        n, length, _ = scores.shape
        trans = self.p["t"]
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0]
        for t in range(1, length):
            alpha[:, t] = scores[:, t] + _lse(alpha[:, t - 1, :, None] + trans, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = _lse(trans + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _lse(alpha[:, -1], 1)
        unary = np.exp(alpha + beta - total[:, None, None])
        if not pairs:
            return unary, total, None
        joint = np.zeros((TAGS, TAGS))
        for t in range(1, length):
            joint += np.exp(alpha[:, t - 1, :, None] + trans + (scores[:, t] + beta[:, t])[:, None, :]
                            - total[:, None, None]).sum(axis=0)
        return unary, total, joint

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        n, length, _ = scores.shape
        best, back = scores[:, 0], []
        for t in range(1, length):
            options = best[:, :, None] + self.p["t"]
            back.append(options.argmax(axis=1))
            best = options.max(axis=1) + scores[:, t]
        tags = np.zeros((n, length), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 2, -1, -1):
            tags[:, t] = back[t][np.arange(n), tags[:, t + 1]]
        return tags

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam on the CRF's log likelihood."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for at in range(0, len(ids), BATCH):
                x, y = ids[order[at:at + BATCH]], tags[order[at:at + BATCH]].astype(np.int64)
                scores, both, fs, bs = self.emissions(x)
                unary, _, joint = self.marginals(scores, pairs=True)
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                d = unary.copy()
                np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
                grads["t"] += joint
                np.add.at(grads["t"], (y[:, :-1], y[:, 1:]), -1.0)
                grads["w"] = np.einsum("nth,ntk->hk", both, d)
                grads["o"] = d.sum(axis=(0, 1))
                dboth = d @ self.p["w"].T
                self._lstm_back(x, "f", fs, dboth[:, :, :HIDDEN], grads)
                self._lstm_back(x[:, ::-1], "b", bs, dboth[:, ::-1, HIDDEN:], grads)
                step += 1
                for k, g in grads.items():
                    g = g / len(x)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (
                        np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def spans(self, ids: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """Per window (start, kind, end, certainty) of the decoded spans; certainty
        is the least posterior among a span's tags."""
        scores = self.emissions(ids)[0]
        tags, unary = self.viterbi(scores), self.marginals(scores)[0]
        out = []
        for row, post in zip(tags, unary):
            found, t = [], 0
            while t < len(row):
                if row[t] % 2 == 1:
                    end = t + 1
                    while end < len(row) and row[end] == row[t] + 1:
                        end += 1
                    sure = float(post[np.arange(t, end), row[t:end]].min())
                    found.append((t, int(row[t]) // 2, end, sure))
                    t = end
                else:
                    t += 1
            out.append(found)
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _window(ids: np.ndarray, start: int) -> np.ndarray:
    out = np.full(WINDOW, CHARS, np.int16)  # the last class pads
    part = ids[start:start + WINDOW]
    out[:len(part)] = part
    return out


def labelled_windows(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """A bounded sample (``sample`` windows, by hash) of windows with their tags."""
    def run(batches):
        for batch in batches:
            ids, tags = [], []
            for text in batch.column("text").to_pylist():
                chars, marks = char_ids(text), tags_of(text, base_spans(text))
                for start in window_starts(text):
                    ids.append(_window(chars, start).tobytes())
                    row = np.zeros(WINDOW, np.int8)
                    part = marks[start:start + WINDOW]
                    row[:len(part)] = part
                    tags.append(row.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(tags, pa.binary())], names=["ids", "tags"])

    rows = docs.where(F.col("text").rlike("[0-9@]")).select("text") \
        .mapInArrow(run, "ids binary, tags binary").distinct() \
        .orderBy(F.xxhash64("ids"), "ids", "tags").limit(sample).collect()
    if not rows:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int8)
    return (np.stack([np.frombuffer(bytes(r.ids), np.int16) for r in rows]).astype(np.int64),
            np.stack([np.frombuffer(bytes(r.tags), np.int8) for r in rows]))


def train(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """A network fitted to the sample; without labelled windows it finds nothing
    of its own (all its tags start out uncertain)."""
    network = Network()
    ids, tags = labelled_windows(docs, sample)
    if len(ids):
        network.fit(ids, tags)
    return network


def reconcile(text_length: int, base: list[tuple[int, str, int]],
              found: list[tuple[int, int, int, float]]) -> list[tuple[int, str, int]]:
    """All spans of a document: base ones, and certain others that overlap none of
    these and no more certain one."""
    taken = [(s, e) for s, _, e in base]
    added = []
    for start, kind, end, sure in sorted(found, key=lambda f: (-f[3], f[0], f[1], f[2])):
        if sure >= CERTAIN and end <= text_length and all(e <= start or end <= s for s, e in taken):
            taken.append((start, end))
            added.append((start, KINDS[kind], end))
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def find(docs: DataFrame, network: Network, redact: bool = False) -> DataFrame:
    """``docs`` with base and spans: arrays of (kind, start, end) in code points.
    With ``redact`` the text comes back with its spans replaced.

    A null text counts as empty and has none; whole texts are read, of any
    length; columns of these names are replaced; equal rows give equal rows. The
    network (a few thousand numbers) goes along with the task.
    """
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()),
                                     T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))
    names = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    schema = T.StructType([docs.schema[c] for c in names] + [
        T.StructField("base", span), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            found: list[list] = [[] for _ in texts]
            windows, places = [], []

            def decode():
                spans = network.spans(np.stack(windows).astype(np.int64))
                for (doc, start), row in zip(places, spans):
                    last = start + WINDOW >= len(texts[doc])
                    for s, k, e, sure in row:
                        middle = (s + e) // 2
                        low = 0 if start == 0 else WINDOW // 4
                        high = WINDOW if last else WINDOW - WINDOW // 4
                        if low <= middle < high:
                            found[doc].append((start + s, k, start + e, sure))
                windows.clear()
                places.clear()

            for doc, text in enumerate(texts):
                starts = window_starts(text)
                if starts:
                    chars = char_ids(text)
                    for start in starts:
                        windows.append(_window(chars, start))
                        places.append((doc, start))
                        if len(windows) >= 512:
                            decode()
            if windows:
                decode()
            spans = [reconcile(len(t), b, f) for t, b, f in zip(texts, base, found)]
            shaped = lambda rows: pa.array([[{"kind": k, "start": s, "end": e}
                                             for s, k, e in r] for r in rows], kind)
            columns = {c: batch.column(c) for c in names}
            if redact:
                columns["text"] = pa.array([redacted(t, s) for t, s in zip(
                    batch.column("text").to_pylist(), spans)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), shaped(base), shaped(spans)], names=names + ["base", "spans"])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def redacted(text: str | None, spans: list[tuple[int, str, int]]) -> str | None:
    """``text`` with each span replaced by its kind in angle brackets; a span that
    starts inside an earlier one is covered with it."""
    if not spans:
        return text
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]
