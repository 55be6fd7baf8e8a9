"""A wavelet matrix over token ids in one self-contained file, with access, counting and occurrence lookup.

Layout, little-endian: 4 bytes ``TLW1``; uint64 n_tokens; uint32 n_docs, alphabet size, planes; the alphabet (uint32,
ascending); the documents' token counts (uint32), ids (int64) and null flags (uint8), zstd-compressed behind a uint32
length; then for each plane, most significant first: uint64 zeros, uint32 ones before each block of 512 bits, and the bits
themselves, packed.  Tokens are stored as ranks in the alphabet, so a file has only as many planes as its own ids need."""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np
import zstandard

MAGIC = b"TLW1"
_BLOCK = 512


def encode(tokens: np.ndarray, counts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    alphabet, ranks = _ranks(tokens)
    planes = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    table = np.asarray(counts, "<u4").tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], "u1").tobytes()
    table = zstandard.ZstdCompressor(level=3).compress(table)
    out = [MAGIC, struct.pack("<QIII", len(tokens), len(doc_ids), len(alphabet), planes), alphabet.astype("<u4").tobytes(), struct.pack("<I", len(table)), table]
    for bit in range(planes - 1, -1, -1):
        ones = (ranks & ranks.dtype.type(1 << bit)).astype(bool)
        bits = np.packbits(ones, bitorder="little")
        out += [struct.pack("<Q", len(ones) - int(np.count_nonzero(ones))), _block_ranks(bits, len(ones)).tobytes(), bits.tobytes()]
        ranks = np.concatenate([ranks[~ones], ranks[ones]])
    return b"".join(out)


def _ranks(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and each token's place among them."""
    if not len(tokens):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint16)
    seen = np.zeros(int(tokens.max()) + 1, bool)
    seen[tokens] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    kind = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
    place = np.zeros(len(seen), kind)
    place[alphabet] = np.arange(len(alphabet), dtype=kind)
    return alphabet, place[tokens]


def _block_ranks(bits: np.ndarray, n: int) -> np.ndarray:
    size = _BLOCK // 8
    blocks = -(-n // _BLOCK)
    padded = np.zeros(blocks * size, np.uint8)
    padded[: len(bits)] = bits
    sums = np.bitwise_count(padded).reshape(-1, size).sum(1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(sums, dtype=np.uint32)]).astype("<u4")


class WaveletFile:
    """Reads a file's bytes in place."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        self.n, self.n_docs, size, planes = struct.unpack_from("<QIII", content, 4)
        at = 24
        self.alphabet = np.frombuffer(content, "<u4", size, at)
        at += 4 * size
        (length,) = struct.unpack_from("<I", content, at)
        table = zstandard.ZstdDecompressor().decompress(content[at + 4 : at + 4 + length])
        at += 4 + length
        self.counts = np.frombuffer(table, "<u4", self.n_docs).astype(np.int64)
        ids = np.frombuffer(table, "<i8", self.n_docs, 4 * self.n_docs).tolist()
        nulls = np.frombuffer(table, "u1", self.n_docs, 12 * self.n_docs)
        self.doc_ids = [None if gone else x for x, gone in zip(ids, nulls, strict=True)]
        self.planes: list[tuple[int, np.ndarray, np.ndarray]] = []
        blocks, width = -(-self.n // _BLOCK) + 1, -(-self.n // 8)
        for _ in range(planes):
            (zeros,) = struct.unpack_from("<Q", content, at)
            ranks = np.frombuffer(content, "<u4", blocks, at + 8)
            self.planes.append((zeros, ranks, np.frombuffer(content, np.uint8, width, at + 8 + 4 * blocks)))
            at += 8 + 4 * blocks + width

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(self.counts)])

    @staticmethod
    def _ones(plane: tuple[int, np.ndarray, np.ndarray], i: int) -> int:
        """Ones before position i."""
        block, rest = divmod(i, _BLOCK)
        bits = plane[2][block * (_BLOCK // 8) : block * (_BLOCK // 8) + -(-rest // 8)]
        n = int(plane[1][block]) + int(np.bitwise_count(bits).sum())
        if rest % 8:
            n -= (int(bits[-1]) >> (rest % 8)).bit_count()
        return n

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        rank = 0
        for plane in self.planes:
            one = int(plane[2][i >> 3]) >> (i & 7) & 1
            before = self._ones(plane, i)
            i = plane[0] + before if one else i - before
            rank = rank * 2 + one
        return int(self.alphabet[rank])

    def _path(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _interval(self, rank: int, a: int, b: int) -> tuple[int, int]:
        for level, plane in enumerate(self.planes):
            x, y = self._ones(plane, a), self._ones(plane, b)
            a, b = (plane[0] + x, plane[0] + y) if rank >> (len(self.planes) - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in [start, end)."""
        if (rank := self._path(token)) is None:
            return 0
        a, b = self._interval(rank, start, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of a token."""
        rank = self._path(token)
        a, b = self._interval(rank, 0, self.n) if rank is not None else (0, 0)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = rank >> (len(self.planes) - 1 - level) & 1
            i = self._find(level, i - self.planes[level][0] if one else i, bool(one))
        return i

    @cached_property
    def _zero_ranks(self) -> list[np.ndarray]:
        """Zeros before each block, plane by plane."""
        return [np.minimum(np.arange(len(ranks), dtype=np.int64) * _BLOCK, self.n) - ranks for _, ranks, _ in self.planes]

    def _find(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th one or zero of a plane: a binary search over blocks, then one block's bits."""
        ranks = self.planes[level][1] if one else self._zero_ranks[level]
        block = int(np.searchsorted(ranks, ranks.dtype.type(k), side="right")) - 1
        first = block * (_BLOCK // 8)
        bits = np.unpackbits(self.planes[level][2][first : first + _BLOCK // 8], bitorder="little")[: min(_BLOCK, self.n - block * _BLOCK)]
        return block * _BLOCK + int(np.flatnonzero(bits == int(one))[k - int(ranks[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes' partitions are undone from the last to the first."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        low = np.zeros(self.n, kind)
        for level, (zeros, _, bits) in enumerate(reversed(self.planes)):
            ones = np.unpackbits(bits, count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, kind)
            out[ones] = low[zeros:] | kind(1 << level)
            out[~ones] = low[:zeros]
            low = out
        return self.alphabet[low] if self.n else np.zeros(0, np.uint32)
