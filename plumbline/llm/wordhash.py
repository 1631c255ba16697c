"""Vectorised word hashing over Arrow text columns, used inside Spark tasks.

A *word* is a maximal run of bytes other than space and the controls 0x09-0x0D (the regex
``[^\\x20\\x09-\\x0D]+`` on UTF-8 text).  Every word gets a 64-bit hash computed from prefix sums of a
tabulated polynomial, so a batch of documents is hashed without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240117)
#: One random 64-bit value per byte, and the odd base of the polynomial with its inverse modulo 2**64.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Multipliers for the words of a window, by their place.
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_POW = _powers(_BASE, _SEGMENT + 1)
_INV = _powers(_INVERSE, _SEGMENT + 1)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of ``column`` (text, binary or a list of binaries), so memory
    doesn't follow the number of rows in a batch; a longer row comes alone."""
    for batch in batches:
        cells = batch.column(batch.schema.names.index(column))
        if pa.types.is_list(cells.type):
            inner = np.concatenate([[0], np.cumsum(pc.binary_length(cells.values.cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False))])
            sizes = np.diff(inner[cells.offsets.to_numpy()])
        else:
            sizes = pc.binary_length(cells.cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes)
        lo = 0
        while lo < len(sizes):
            before = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, before + size, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n+1 offsets of its rows in them; a null row is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Places:
    """Places of 64-bit keys in the order in which they were added, by an open hash table at a quarter of its room."""

    def __init__(self, keys: np.ndarray | None = None):
        self.keys = np.zeros(0, np.uint64)
        self.slots, self.bits = np.zeros(0, np.int32), 0
        self.add(self.keys if keys is None else keys)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        """Add keys that aren't there and don't repeat."""
        have = len(self.keys)
        self.keys = np.concatenate([self.keys, keys.astype(np.uint64)])
        if 4 * len(self.keys) > len(self.slots) or not self.bits:
            self.bits, have = max(10, int(4 * len(self.keys)).bit_length()), 0
            self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(have, len(self.keys), dtype=np.int32)
        at = self._home(self.keys[have:])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several for one slot, one stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each of ``keys``; the number of all for those that aren't there."""
        n, keys = len(self.keys), keys.astype(np.uint64)
        at = self._home(keys)
        out = self.slots[at].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self.keys[np.minimum(out, n - 1)] != keys)) if n else np.zeros(0, np.int64)
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[np.minimum(out[open_], n - 1)] != keys[open_])]
        out[out < 0] = n
        return out


def hashes_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges, which ascend and don't overlap."""
    hashes = np.zeros(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        # as many ranges as fit a segment; one longer than that is hashed alone, piece by piece
        hi = int(np.searchsorted(ends, starts[lo] + _SEGMENT, side="right"))
        if hi <= lo:
            h = 0
            for s in range(int(starts[lo]), int(ends[lo]), _SEGMENT):
                part = _BYTE[raw[s : min(s + _SEGMENT, int(ends[lo]))]]
                h = (h * _BASE + int(np.sum(part * _POW[: len(part)], dtype=np.uint64))) % 2**64
            hashes[lo] = h
            lo += 1
            continue
        first = int(starts[lo])
        part = _BYTE[raw[first : int(ends[hi - 1])]]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * _POW[: len(part)], out=total[1:])
        s, e = starts[lo:hi] - first, ends[lo:hi] - first
        hashes[lo:hi] = (total[e] - total[s]) * _INV[s]
        lo = hi
    return mix(hashes + (ends - starts).astype(np.uint64))


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte offsets in the flat text) and hash of each word, and the n+1 offsets of rows in words.

    With ``lower`` the letters A-Z are folded to a-z before hashing.
    """
    raw, off = flat_bytes(texts)
    is_word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)  # a word starts here if the byte before is a space or of another row
    edge[off] = True
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = False
        before[1:] = is_word[:-1]
        before[edge[:-1]] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.zeros(len(raw), dtype=bool)
    if len(raw):
        after[:-1] = is_word[1:]
        after[edge[1:]] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    rows = np.searchsorted(starts, off).astype(np.int64)
    return starts, ends, hashes_of(_LOWER[raw] if lower else raw, starts, ends), rows


def windows(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether those k words lie in one row."""
    n = len(hashes)
    out = np.zeros(n, dtype=np.uint64)
    ok = np.zeros(n, dtype=bool)
    if n >= k:
        for i in range(k):
            out[: n - k + 1] += hashes[i : n - k + 1 + i] * _PLACE[i]
        left = np.repeat(rows[1:], np.diff(rows)) - np.arange(n)
        ok = left >= k
    return mix(out), ok
