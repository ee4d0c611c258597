"""Words of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
BUFFER = 1 << 20


def byte_table(is_word) -> bytes:
    """For bytes.translate: A-Z lower-cased, bytes outside words to a space."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if is_word(b) else 32 for b in range(256))


# Letters, digits and everything outside ASCII.
ALNUM = byte_table(lambda b: b >= 128 or chr(b).isalnum())
# Everything but ASCII white space.
NON_SPACE = byte_table(lambda b: b not in b" \t\n\v\f\r")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the multiplier and of its inverse, as many as were ever needed."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), BUFFER)
            with np.errstate(over="ignore"):
                self.up, self.down = np.full((2, size), MULTIPLIER, np.uint64)
                self.down[:] = INVERSE
                for powers in (self.up, self.down):
                    powers[0] = 1
                    np.cumprod(powers, out=powers)
        return self.up, self.down


POWERS = _Powers()


def _hash_buffer(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each run of bytes other than the space."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = data != 32
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = POWERS.get(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def hash_words(texts: list[str | None], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the words of all texts in order, and where each text's end."""
    hashes, counts = [], []
    waiting: list[bytes] = []
    size = 0

    def flush():
        data = np.frombuffer(b" ".join(waiting) + b" ", np.uint8)
        found, starts = _hash_buffer(data)
        stops = np.cumsum([len(w) + 1 for w in waiting])
        hashes.append(found)
        counts.append(np.diff(np.concatenate([[0], np.searchsorted(starts, stops)])))

    for text in texts:
        waiting.append((text or "").encode("utf-8", "surrogatepass").translate(table))
        size += len(waiting[-1])
        if size > BUFFER:
            flush()
            waiting, size = [], 0
    if waiting:
        flush()
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(MULTIPLIER) + hashes[k:k + n]
    return mix(out)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Windows of ``width`` words; all words as one where there are fewer."""
    if 0 < len(hashes) < width:
        return windows(hashes, len(hashes))
    return windows(hashes, width)
