"""Word splitting and hashing over raw UTF-8 buffers with numpy: no Python object per word.

Words are maximal runs of bytes outside [\\x20\\x09-\\x0D]. UTF-8 lead and continuation bytes lie above 0x7F, so
splitting bytes equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
IS_WS = np.zeros(256, bool)
IS_WS[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, every other byte to itself.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
#: Bytes of text handled at once; a single longer document is handled whole.
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: Another value for each byte: hashes that have nothing to do with those of _TABLE.
_OTHER = mix(_TABLE ^ U64(0xA0761D6478BD642F))
_BASE = 0xD6E8FEB86659FD93
_power = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """Powers 0 to n-1 of the base, modulo 2**64."""
    global _power
    if len(_power) < n:
        grown = np.full(max(n, 2 * len(_power)), U64(_BASE))
        grown[0] = 1
        _power = np.cumprod(grown, dtype=U64)
    return _power[:n]


class Words:
    """Words of consecutive documents: start and end byte in `buf`, 64-bit hash, and offsets of each document's words."""

    __slots__ = ("buf", "start", "end", "hash", "offset")

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, fold: np.ndarray = SAME, hashes: bool = True, counted: np.ndarray | None = None):
        """bounds: byte offsets of the documents in buf, one more than documents. counted: the bytes that matter to a word's hash, if not all."""
        self.buf = buf
        solid = ~IS_WS[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[bounds] = True
        before, after = np.empty_like(solid), np.empty_like(solid)
        before[:1], after[-1:] = True, True
        before[1:] = ~solid[:-1]
        after[:-1] = ~solid[1:]
        before |= cut[:-1]
        after |= cut[1:]
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.offset = np.searchsorted(self.start, bounds)
        self.hash = self._hash(fold, counted) if hashes else None

    def other(self) -> np.ndarray:
        """A second hash of every word, independent of the first."""
        return self._hash(SAME, None, _OTHER)

    def _hash(self, fold: np.ndarray, counted: np.ndarray | None, table: np.ndarray = _TABLE) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        table = table[fold]
        table[IS_WS] = 0
        first, last = self.start[0], len(self.buf)
        gaps = np.diff(np.append(self.start, last))
        at = np.arange(first, last) - np.repeat(self.start, gaps)
        value = table[self.buf[first:]]
        if counted is None:
            value *= powers(int(gaps.max()))[at]
            return mix(np.add.reduceat(value, self.start - first) + (self.end - self.start).astype(U64))
        # The place of a byte in its word is its place among the bytes that count.
        real = counted[self.buf[first:]]
        value[~real] = 0
        rank = np.cumsum(real)
        rank -= np.repeat(rank[self.start - first] - real[self.start - first], gaps)
        value *= powers(int(rank.max()) + 1)[rank]
        return mix(np.add.reduceat(value, self.start - first))

    def __len__(self) -> int:
        return len(self.offset) - 1

    def doc_of_word(self) -> np.ndarray:
        """The document of each word, counted from 0."""
        return np.repeat(np.arange(len(self)), np.diff(self.offset))

    def grams(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows that lie in one document, from the hashes of the words, and the index of each window's first word."""
        own = self.hash if hashes is None else hashes
        m = len(own) - n + 1
        if m <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        value = np.zeros(m, U64)
        for k in range(n):
            value += own[k : k + m] * powers(n + 1)[k + 1]
        doc = self.doc_of_word()
        at = np.flatnonzero(doc[:m] == doc[n - 1 :])
        return mix(value[at]), at


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, and document offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets.astype(np.int64)


def chunks(column: pa.Array | pa.ChunkedArray, fold: np.ndarray = SAME, hashes: bool = True, size: int = CHUNK, solid: np.ndarray | None = None) -> Iterator[tuple[int, Words]]:
    """The column in runs of documents of about `size` bytes: the index of the first, and the words."""
    base = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(part):
            data, offsets = buffers(part)
            first = 0
            while first < len(part):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
                bounds = offsets[first : last + 1]
                yield base + first, Words(data[bounds[0] : bounds[-1]], bounds - bounds[0], fold, hashes, solid)
                first = last
        base += len(part)
