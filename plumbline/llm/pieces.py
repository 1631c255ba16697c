"""Splitting plain texts into a tokenizer's pieces, and remembering the ids of pieces, in whole slices of texts.

A plain text has ASCII, Latin letters that NFC leaves alone and that have one lower-case letter each, and common signs,
none of which are letters, numbers or spaces.  Pieces are known by 64-bit hashes: among n different ones about
n*n/2**65 pairs are confused.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from plumbline.llm.wordhash import Places, hashes_of

PLAIN = re.compile("[\x00-\x7f¡-©«-±´¶-¸»¿-ÖØ-öø-įı-ſ–—‘’“”…€]*")
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Class of each byte; those that go on a character have its first byte's.
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0xC3, 0xC6)]] = LETTER
_CLASS[ord("0") : ord("9") + 1] = NUMBER


def classes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte's character, and whether the byte goes on a character."""
    kind, on = _CLASS[raw], (raw & 0xC0) == 0x80
    for _ in range(2):  # a plain character has at most three bytes
        kind[1:][on[1:]] = kind[:-1][on[1:]]
    return kind, on


def cut_endings(raw: np.ndarray, off: np.ndarray, new: np.ndarray, quotes: np.ndarray) -> None:
    """Make pieces of 's, 't, 'm, 'd, 're, 've and 'll in ``new`` (where pieces start) at ``quotes`` (signs that start one)."""
    n = len(raw)
    room = off[np.searchsorted(off, quotes, side="right")] - quotes
    after = lambda k: np.where(room > k, raw[np.minimum(quotes + k, n - 1)], 0)
    one, two = after(1), after(2)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for at, size in ((quotes[short], 2), (quotes[long], 3)):
        new[at + 1] = False
        end = at + size
        new[end[end < n]] = True


class Memory:
    """Ids of pieces that were seen; all are forgotten where they are more than ``most``."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 600_000):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.places, self.starts, self.ids = Places(), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def codes(self, raw: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Of each text with offsets ``off`` in ``raw``, the ids of its pieces as little-endian 32-bit integers."""
        hashes = hashes_of(raw, starts, ends)
        if len(self.places.keys) > self.most:
            self.forget()
        at = self.places.find(hashes)
        missing = np.flatnonzero(at == len(self.places.keys))
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            first, data = missing[first], raw.tobytes()
            codes = self.encode([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(c) for c in codes])])
            self.ids = np.concatenate([self.ids, np.array([i for c in codes for i in c], dtype="<u4")])
            self.places.add(new)
            at[missing] = self.places.find(hashes[missing])
        sizes = self.starts[at + 1] - self.starts[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[at] - upto[:-1], sizes) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(starts, off)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
