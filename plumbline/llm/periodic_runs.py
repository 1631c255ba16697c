"""Periodic runs of words: maximal stretches that repeat a shortest unit four times or more.

Block matching: for each power of two B, periods from B up to 2B - 1 are found by blocks of B words that start at
multiples of B.  A run of four periods holds such a block and its copy one period further on.  The blocks of a stretch
are the keys of an Aho-Corasick automaton over integer sequences that is run along the stretch; an occurrence that lies
between B and 2B - 1 words after an equal block is a seed, which is extended word by word to both sides.  Blocks of more
than 64 words are written as 64 names of equal pieces (names are ranks of pairs of names, by doubling), so automata stay
small and the text is run through by residues.

Where no run can be, nothing is searched: all words of a run but those of its first period occurred at most a period
before.  Stretches of such words are found by NumPy for a whole batch of texts.  Scales ascend, so a seed inside a run of a
shorter period is a multiple of that and is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import map_rows, named
from plumbline.llm.wordhash import by_bytes, words_of

#: Letters of a key, words searched at a time.
_KEY, _CHUNK = 64, 1 << 19
_NEVER = 2**62


def _left(w: np.ndarray, i: int, q: int, low: int) -> int:
    """The smallest l from ``low`` on with w[l:i] equal to w[l + q:i + q]."""
    step = 32
    while i > low:
        k = max(low, i - step)
        other = np.flatnonzero(w[k:i] != w[k + q : i + q])
        if len(other):
            return k + int(other[-1]) + 1
        i, step = k, 2 * step
    return low


def _right(w: np.ndarray, j: int, q: int, high: int) -> int:
    """The largest r up to ``high`` with w[j:r] equal to w[j - q:r - q]."""
    step = 32
    while j < high:
        k = min(high, j + step)
        other = np.flatnonzero(w[j:k] != w[j - q : k - q])
        if len(other):
            return j + int(other[0])
        j, step = k, 2 * step
    return high


def _names(w: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for equal windows of ``length`` (a power of two) words."""
    names, size = w, 1
    while size < length:
        pairs = names[:-size].astype(np.int64) << 32 | names[size:].astype(np.int64)
        names, size = np.unique(pairs, return_inverse=True)[1], 2 * size
    return names


def _seeds(w: np.ndarray, first: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks (multiples of ``block`` from ``first`` on) and of equal words ``block`` to 2 * ``block`` - 1 further on."""
    step = max(1, block // _KEY)
    names = _names(w, step)
    at = np.arange(first, len(w) - block + 1, block)
    keys = [tuple(k) for k in names[at[:, None] + np.arange(0, block, step)].tolist()]
    number: dict[tuple, int] = {}
    own = np.array([number.setdefault(k, len(number)) for k in keys], dtype=np.int64)
    if not len(own):
        return at, at
    search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, n in number.items():
        search.add_word(key, n)
    search.make_automaton()
    starts, which = [], []
    for residue in range(min(step, len(names))):
        found = np.fromiter(chain.from_iterable(search.iter(tuple(names[residue::step].tolist()))), dtype=np.int64).reshape(-1, 2)
        starts.append((found[:, 0] - (block // step - 1)) * step + residue)
        which.append(found[:, 1])
    start, what = np.concatenate(starts), np.concatenate(which)
    n = (start - block - first) // block
    fits = (n >= 0) & (n < len(own)) & (start >= block + first)
    start, what, n = start[fits], what[fits], n[fits]
    same = own[n] == what
    return at[n[same]], start[same]


class _Known:
    """The runs of one text, and what lies inside one of them."""

    def __init__(self) -> None:
        self.runs: set[tuple[int, int, int]] = set()
        self.order()

    def order(self) -> None:
        ordered = sorted(self.runs)
        self.starts = np.array([r[0] for r in ordered], dtype=np.int64)
        self.ends = np.maximum.accumulate(np.array([r[1] for r in ordered], dtype=np.int64)) if ordered else self.starts

    def inside(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(start), dtype=bool)
        before = np.searchsorted(self.starts, start, side="right") - 1
        return (before >= 0) & (self.ends[before] >= end)


def _scale(w: np.ndarray, a: int, b: int, block: int, known: _Known, least: int, times: int, chunk: int = _CHUNK) -> None:
    """Add to ``known`` the runs that lie in w[a:b] and have periods from ``block`` to 2 * ``block`` - 1."""
    if known.inside(np.array([a]), np.array([b]))[0]:
        return
    found = set()
    chunk = max(chunk, 16 * block)
    for lo in range(a, b, chunk):
        hi = min(b, lo + chunk + 3 * block)
        ps, os_ = _seeds(w[lo:hi], -lo % block, block)
        ps, os_ = ps + lo, os_ + lo
        new = ~known.inside(ps, os_ + block)
        ps, os_ = ps[new], os_[new]
        period = os_ - ps
        for q in np.unique(period).tolist():
            starts = ps[period == q]
            starts.sort()
            i = 0
            while i < len(starts):
                p = int(starts[i])
                left, right = _left(w, p, q, 0), _right(w, p + q + block, q, len(w))
                if right - left >= max(least, times * q):
                    found.add((left, right, q))
                i = max(i + 1, int(np.searchsorted(starts, right - q - block, side="right")))
    if found:
        known.runs |= found


def runs_of(h: np.ndarray, rows: np.ndarray, least: int = 6, times: int = 4, chunk: int = _CHUNK) -> list[list[tuple[int, int, int]]]:
    """Runs (start, end, period; words, end exclusive) of each row of a batch, by start and period; ``h`` has a hash of each word, ``rows``
    the rows' offsets.  ``times`` is at least 4."""
    n = len(rows) - 1
    known: dict[int, _Known] = {}
    if not len(h):
        return [[] for _ in range(n)]
    w = np.unique(h, return_inverse=True)[1]
    row = np.repeat(np.arange(n), np.diff(rows))
    order = np.argsort(w, kind="stable")
    gap = np.full(len(w), _NEVER)
    again = (w[order[1:]] == w[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    gap[order[1:][again]] = (order[1:] - order[:-1])[again]
    longest, block = int(np.diff(rows).max()), 1
    while times * block <= longest:
        near = np.concatenate([[False], gap < 2 * block, [False]])
        edge = np.flatnonzero(near[1:] != near[:-1])
        starts, ends = edge[::2], edge[1::2]
        # a run of period q is at least max(least, times * q) long, and all but its first q words are near
        need = min(max(least - q, (times - 1) * q) for q in range(block, 2 * block) if q <= max(block, least))
        long_ = ends - starts >= need
        touched = set()
        for s, e in zip(starts[long_].tolist(), ends[long_].tolist()):
            d = int(row[s])
            base, top = int(rows[d]), int(rows[d + 1])
            k = known.setdefault(d, _Known())
            _scale(w[base:top], max(0, s - base - 2 * block + 1), e - base, block, k, least, times, chunk)
            touched.add(d)
        for d in touched:
            known[d].order()
        block *= 2
    return [sorted(known[d].runs, key=lambda r: (r[0], r[2])) if d in known else [] for d in range(n)]


def _drops(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of words that lie in a run after its first period, apart and in order."""
    out: list[list[int]] = []
    for a, b in sorted((start + q, end) for start, end, q in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def find_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """Add ``n_words``, ``runs`` (array of ``start``, ``length``, ``period`` in words, by start, then period) and ``collapsed`` to ``docs``.

    A run is a stretch of at least max(``least``, ``times`` * period) words in which words a (smallest) period apart are identical and
    that no neighbouring word extends; ``times`` is at least 4.  ``collapsed`` has the words that no run contains after its first period,
    joined by single spaces.  A null or empty text has no words, no runs and an empty ``collapsed``.  Texts of any length are searched
    whole, a very long one alone in its batch.  Rows stand alone, so repeated rows get the same each and order doesn't matter.
    Columns of the three names are replaced, others pass through; an empty table gives none.  Words are compared by 64-bit
    hashes.
    """
    if times < 4:
        raise ValueError("times must be 4 or more")
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    docs = docs.select(*named(kept))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in by_bytes(batches, text):
            texts = batch.column(batch.schema.names.index(text)).cast(pa.large_string())
            _, _, h, rows = words_of(texts)
            found = runs_of(h, rows, least, times)
            out = []
            for t, runs in zip(texts, found):
                words = (t.as_py() or "").encode().split()  # at the same six characters as words_of
                for a, b in reversed(_drops(runs)):
                    del words[a:b]
                out.append(b" ".join(words).decode())
            spans = [[{"start": a, "length": b - a, "period": q} for a, b, q in runs] for runs in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(rows)), pa.array(spans, kind), pa.array(out, pa.string())], names=[*batch.schema.names, "n_words", "runs", "collapsed"])

    return map_rows(docs, run, schema)
