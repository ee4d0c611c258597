"""Cached byte-level BPE over chunks of text that no pre-token crosses.

The pre-token pattern of the public byte-level vocabularies never matches across
the place before a space that has a non-space on either side, so a text may be
cut there and each chunk encoded on its own. Natural text repeats its chunks,
and the tokenizers library is asked once for every new one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402  (reads the setting)

# White space other than the space and the line feed; NUL separates chunks below.
RARE = re.compile("[\0\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RUNS = ("  ", " \n", "\n ", "\n\n")
SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
CUT_AT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f]"
# A word is one match of the pattern, a full stop or comma after it another.
WORD = re.compile(rf"\0( ?{LETTER}+)([.,]?)(?=\0)")


def byte_chars() -> dict[int, int]:
    """Byte -> printable code point, the mapping of byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: b for b in printable}
    for b in range(256):
        if b not in table:
            table[b] = 256 + len(table) - len(printable)
    return table


def slices(text: str, size: int) -> Iterator[str]:
    """Whole text in pieces of about ``size`` characters, cut only where the
    pattern's matches end; a text without such a place stays one piece."""
    start = 0
    while len(text) - start > size:
        cut = CUT_AT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


class ChunkEncoder:
    """ids of whole texts as little-endian unsigned 32-bit integers.

    ``tokenizer`` is a byte-level tokenizers.Tokenizer, ``token_bytes`` the bytes
    of each id. The cache holds at most twice ``entries`` chunks.
    """

    def __init__(self, tokenizer, token_bytes: list[bytes], entries: int = 150_000):
        self.tokenizer = tokenizer
        # Words are whole matches already, so the model alone may encode them.
        self.words = Tokenizer(tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.chars = byte_chars()
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)
        self.entries = entries
        self.seed = {"": b""} | {mark: self._ids(mark) for mark in (".", ",", "\n")}
        self.new: dict[str, bytes] = dict(self.seed)
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new chunks of all of them are asked for together."""
        get = self.new.get
        found, gaps = [], []
        missing: set[str] = set()
        for text in texts:
            own: list = []
            for piece in slices(text, 1 << 20):
                chunks = self._chunks(piece)
                values = list(map(get, chunks))
                if None in values:
                    holes = [i for i, value in enumerate(values) if value is None]
                    words = [chunks[i] for i in holes]
                    missing.update(words)
                    gaps.append((values, holes, words))
                own.append(values)
            found.append(own)
        if missing:
            self._learn(missing)
            for values, holes, words in gaps:
                for i, ids in zip(holes, map(get, words)):
                    values[i] = ids
        out = [b"".join(own[0]) if len(own) == 1 else b"".join(map(b"".join, own)) for own in found]
        if len(self.new) > self.entries:
            self.old, self.new = self.new, dict(self.seed)
        return out

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if RARE.search(text) or any(run in text for run in RUNS):
            return SAFE_CUT.split(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def _learn(self, missing: set[str]) -> None:
        known, old = self.new, self.old
        kept = [chunk for chunk in missing if chunk in old]
        if kept:
            known.update(zip(kept, map(old.__getitem__, kept)))
            missing = missing.difference(kept)
        found = WORD.findall("\0" + "\0".join(missing) + "\0")
        self._ask_words(list({word for word, _ in found}.difference(known)))
        marked = {word + mark: known[word] + known[mark] for word, mark in found if mark}
        known.update(marked)
        whole = list(missing.difference(known))
        asked = self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)
        for chunk, found in zip(whole, asked):
            known[chunk] = np.array(found.ids, "<u4").tobytes()

    def _ask_words(self, parts: list[str]) -> None:
        """One call for many words; as no byte is lost, the lengths of the ids'
        bytes tell whose they are."""
        if not parts:
            return
        self.chars.pop(10, None)  # no word holds a line feed: it separates them here
        text = "\n".join(parts).encode().decode("latin-1").translate(self.chars)
        found = self.words.encode_batch_fast([text], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        ends = np.cumsum(self.lengths[ids])
        sizes = np.array([len(word) for word in text.split("\n")], np.int64)
        stops = (4 * np.searchsorted(ends, np.cumsum(sizes)) + 4).tolist()
        data, at, known = ids.tobytes(), 0, self.new
        for part, stop in zip(parts, stops):
            known[part] = data[at:stop]
            at = stop
