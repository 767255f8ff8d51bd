"""Vectorised word and n-gram hashes over batches of texts (numpy, no per-word Python).

A batch of texts is laid out as one byte array.  Word hashes are polynomial
hashes modulo 2**64 read off one prefix sum, so their cost is a few array
passes per byte; window hashes over ``k`` words use the same trick over the
word hashes.  All hashes depend on the bytes only: they are the same in every
process, task attempt and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
#: Bytes of ``[\x20\x09-\x0D]``: they separate words; all of UTF-8's other bytes belong to words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Texts of a batch are laid out together up to about this many bytes; one longer text is a batch of its own.
BATCH_BYTES = 1 << 20

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64 (of its inverse if asked), kept for the process."""
    key = (base, inverse)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, (5 * BATCH_BYTES if base == BYTE_BASE else BATCH_BYTES) // 4)
        p = np.full(size, pow(base, -1, 1 << 64) if inverse else base, U64)
        p[0] = 1
        _powers[key] = np.cumprod(p, dtype=U64)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for every range, independent of where it stands."""
    n = len(values)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * powers(base, n), out=total[1:])
    raw = (total[ends] - total[starts]) * powers(base, n + 1, inverse=True)[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """Words of several texts: hash, byte range (within ``data``) and number of the text of each word."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts)
        self.text_starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1].astype(np.int64)
        raw = np.frombuffer(self.data, np.uint8)
        word = ~SPACES[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.hashes = ranges_hash(raw.astype(U64) + U64(1), self.starts, self.ends, BYTE_BASE) if len(edges) else np.zeros(0, U64)
        self.text = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        #: words before each text; one entry more than texts
        self.offsets = np.searchsorted(self.starts, np.append(self.text_starts, len(raw) + 1)).astype(np.int64)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``k`` words that lie in one text, and the number of each one's first word."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[:n] == self.text[k - 1:])
        return ranges_hash(self.hashes, at, at + k, WORD_BASE), at

    def shingle_sets(self, k: int) -> list[np.ndarray]:
        """For each text the sorted distinct hashes of its shingles of ``k`` words; a shorter text is one shingle, an empty one none."""
        hashes, at = self.windows(k)
        cuts = np.searchsorted(at, self.offsets)
        out = []
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            lo, hi = self.offsets[i], self.offsets[i + 1]
            if b > a:
                out.append(np.unique(hashes[a:b]))
            elif hi > lo:
                out.append(ranges_hash(self.hashes[lo:hi], np.array([0]), np.array([hi - lo]), WORD_BASE))
            else:
                out.append(np.zeros(0, U64))
        return out


def batches(texts: list[bytes]) -> Iterator[tuple[int, Words]]:
    """The texts in order as batches of about ``BATCH_BYTES``: number of the first text, words."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_BYTES:
            yield begin, Words(texts[begin:i])
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, Words(texts[begin:])
