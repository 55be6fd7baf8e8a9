"""Words and word k-grams as 64-bit hashes, computed for whole Arrow buffers in numpy.

A text's bytes are hashed once with running sums modulo 2**64 of random byte values times powers of an odd base;
a word's hash is the difference of two sums, shifted back by the inverse power, and mixed.  No Python object is made
for a word or a document."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SEED = np.uint64(0xD1B54A32D192ED03)

#: True for bytes that belong to no word: blanks, and all ASCII but digits and letters.
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a text's bytes, and the factors that shift a difference of two of them back: a stretch [a, b) is told
    by (sums[b] - sums[a]) * down[a], to be mixed."""
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Words:
    """Words of a run of documents: byte ``starts`` and ``ends``, ``hashes``, and ``first``, the index of each document's
    first word (with one entry more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool):
        inside = ~separators[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        cuts = offsets[(offsets < len(data))]
        before[cuts] = False  # a word ends with its document
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = hash_spans(data, self.starts, self.ends, lower)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _BASE + b + _SEED)


def kgrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` values, by doubling; runs across documents are the caller's to drop."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    power, size, done, covered = hashes, 1, None, 0
    while True:
        if k & size:
            if done is None:
                done, covered = power, size
            else:
                n = len(hashes) - covered - size + 1
                done, covered = pair(done[:n], power[covered : covered + n]), covered + size
        if size * 2 > k:
            return done[: len(hashes) - k + 1]
        power, size = pair(power[:-size], power[size:]), size * 2


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a sequence of any length."""
    h = np.array([len(hashes)], np.uint64) * _SEED
    for i in range(len(hashes)):
        h = pair(h, hashes[i : i + 1])
    return h[0]


def inside_documents(words: Words, k: int) -> np.ndarray:
    """For every run start of ``kgrams``: does the run stay in one document?"""
    n = max(0, len(words.hashes) - k + 1)
    left = np.repeat(words.first[1:], words.counts())[:n]  # one past the last word of the document
    return np.arange(n) + k <= left


def hash_text(text: str, separators: np.ndarray, lower: bool) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), separators, lower).hashes


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
