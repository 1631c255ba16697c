"""Byte-level BPE by dynamic programming over prefixes.

The BPE code of a text's prefix ends in one certain token; without it, it is the BPE code of the shorter prefix.  So
for every prefix one last token is stored: among the tokens that the vocabulary's suffix automaton finds to end there,
the one that is compatible with the last token of the prefix before it, meaning that BPE leaves the two apart when it
merges their joint bytes.  Following these back from the end gives the ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import pieces
from plumbline.llm.common import held, map_rows, named
from plumbline.llm.wordhash import flat_bytes

#: Fixed value: the split of texts into pieces, none of which a token crosses.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SuffixAutomaton:
    """The suffix automaton of a set of words: a state stands for the strings that end at the same places of them.

    ``step`` has the next state by ``state << 8 | byte``, ``link`` the state of the longest suffix that ends at more
    places, ``length`` the length of a state's longest string, ``word`` the number of the word that this is (or -1)
    and ``up`` the nearest state along the links that is a word (0: none).
    """

    def __init__(self, words: dict[bytes, int]):
        from array import array

        step: dict[int, int] = {}
        link, length, word = array("i", [-1]), array("i", [0]), array("i", [-1])
        labels = [b""]

        def new(size: int, shown: bytes) -> int:
            link.append(0)
            length.append(size)
            word.append(-1)
            labels.append(shown)
            return len(length) - 1

        def clone(at: int, byte: int, old: int) -> int:
            """Split off ``old`` the strings that ``at`` and its suffixes lead to by ``byte``."""
            part = new(length[at] + 1, labels[old])
            for b in labels[old]:
                step[part << 8 | b] = step[old << 8 | b]
            link[part], link[old] = link[old], part
            while at >= 0 and step.get(at << 8 | byte) == old:
                step[at << 8 | byte] = part
                at = link[at]
            return part

        for text, number in words.items():
            last = 0
            for byte in text:
                known = step.get(last << 8 | byte)
                if known is not None:
                    last = known if length[known] == length[last] + 1 else clone(last, byte, known)
                    continue
                grown, at = new(length[last] + 1, b""), last
                while at >= 0 and (at << 8 | byte) not in step:
                    step[at << 8 | byte] = grown
                    labels[at] += bytes([byte])
                    at = link[at]
                if at >= 0:
                    old = step[at << 8 | byte]
                    link[grown] = old if length[old] == length[at] + 1 else clone(at, byte, old)
                last = grown
            if last:
                word[last] = number
        up = array("i", bytes(4 * len(length)))
        for state in sorted(range(1, len(length)), key=length.__getitem__):
            up[state] = link[state] if word[link[state]] >= 0 else up[link[state]]
        self.step, self.link, self.length, self.word, self.up = step, link, length, word, up

    def matches(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(end, length, word) of all places where a word occurs in ``data``, by their ends, longer ones first."""
        step, link, length, word, up = self.step, self.link, self.length, self.word, self.up
        state = size = 0
        for end, byte in enumerate(data, 1):
            after = step.get(state << 8 | byte)
            while after is None and state:
                state = link[state]
                size = length[state]
                after = step.get(state << 8 | byte)
            if after is None:
                continue
            state, size = after, size + 1
            # of a state's strings only the longest can be a word; those of its links are shorter than any of them
            found = state if size == length[state] and word[state] >= 0 else up[state]
            while found:
                yield end, length[found], word[found]
                found = up[found]


def _split(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of ``PIECES`` in plain texts with offsets ``off``.

    A piece is a run of letters, numbers or other signs with the one space before it; of longer white space, all but
    its last character is a piece, and so is that where it is no space or nothing follows.
    """
    n = len(raw)
    kind, _ = pieces.classes(raw)
    new = np.ones(n, dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    heads = off[:-1][off[:-1] < n]
    new[heads] = True
    last = np.zeros(n, dtype=bool)  # white space before something else in the same text
    last[:-1] = (kind[:-1] == pieces.SPACE) & (kind[1:] != pieces.SPACE)
    last[off[1:][off[1:] > 0] - 1] = False
    new |= last
    joins = np.flatnonzero(last & (raw == 0x20))
    new[joins + 1] = False
    pieces.cut_endings(raw, off, new, np.flatnonzero((raw == ord("'")) & new))
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)[: len(starts)]


class ByteBPE:
    """Vocabulary, merges and suffix automaton of a byte-level ``tokenizers`` JSON file."""

    def __init__(self, path: str, most: int = 300_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: raw(s) for s, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        # a pair is merged after its parts were made; then merges go by rank, and the test of two tokens is a walk
        self.parts = {new: (a, b, rank) for (a, b), (rank, new) in self.merges.items()}
        made = lambda t: self.parts[t][2] if t in self.parts else -1
        self.by_rank = all(rank > max(made(a), made(b)) for a, b, rank in self.parts.values())
        self.edges: tuple[dict[int, list[tuple[int, float]]], ...] = ({}, {})
        self.automaton = SuffixAutomaton({self.bytes[i]: i for i in vocab.values() if i not in self.added.values()})
        self.split = regex.compile(PIECES)
        self.specials = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.apart: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.most = most
        self.memory = pieces.Memory(lambda new: [self.encode_piece(w) for w in new])

    def merged(self, data: bytes) -> list[int]:
        """The code of a few bytes by the merges themselves; serves the compatibility tests."""
        ids = [self.byte_id[b] for b in data]
        while len(ids) > 1:
            best = min((self.merges[p] for p in zip(ids, ids[1:]) if p in self.merges), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.merges.get((ids[i], ids[i + 1]), (-1,))[0] == best[0]:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at the first (0) or last (1) place of a token's bytes as its merges go on, from the byte to the
        token itself, each with the rank of the merge that takes it up."""
        known = self.edges[side].get(token)
        if known is None:
            known, until, at = [], float("inf"), token
            while at in self.parts:
                known.append((at, until))
                until = self.parts[at][2]
                at = self.parts[at][side]
            known.append((at, until))
            known.reverse()
            self.edges[side][token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joint bytes of two tokens are coded as these two: no merge across their border comes first."""
        key = a << 20 | b
        apart = self.apart.get(key)
        if apart is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            if not self.by_rank:
                apart = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
            else:
                left, right, merges = self._edge(a, 1), self._edge(b, 0), self.merges
                i = j = 0
                while True:
                    (one, until), (two, then) = left[i], right[j]
                    found = merges.get((one, two))
                    # of equal merges the leftmost is done first
                    if found is not None and found[0] < until and found[0] <= then:
                        apart = False
                        break
                    if until <= then:
                        i += 1
                    else:
                        j += 1
                    if i == len(left) or j == len(right):
                        apart = True
                        break
            self.apart[key] = apart
        return apart

    def reachable(self, a: int) -> bool:
        if a not in self.alone:
            self.alone[a] = self.merged(self.bytes[a]) == [a]
        return self.alone[a]

    def encode_piece(self, data: bytes) -> list[int]:
        n = len(data)
        last, found = [-1] * (n + 1), 0
        for end, length, token in self.automaton.matches(data):
            if end == found:
                continue
            before = end - length
            if (not before or last[before] >= 0 and self.compatible(last[before], token)) and self.reachable(token):
                last[end], found = token, end
        ids = []
        while n:
            ids.append(last[n])
            n -= len(self.bytes[last[n]])
        return ids[::-1]

    def _plain(self, text: str) -> list[bytes]:
        known, out = self.known, []
        for p in self.split.findall(text):
            code = known.get(p)
            if code is None:
                code = np.array(self.encode_piece(p.encode()), dtype="<u4").tobytes()
                if len(p) <= 64:
                    if len(known) >= self.most:
                        known.clear()
                    known[p] = code
            out.append(code)
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return b"".join(self._plain(text))
        out: list[bytes] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(int(self.added[m[0]]).to_bytes(4, "little"))
            at = m.end()
        return b"".join(out + self._plain(text[at:]))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """:meth:`encode` of each; plain texts without added tokens are split and looked up together."""
        plain = [pieces.PLAIN.fullmatch(t) is not None and not (self.specials and self.specials.search(t)) for t in texts]
        raw, off = flat_bytes(pa.array([t for t, p in zip(texts, plain) if p], pa.large_string()))
        together = iter(self.memory.codes(raw, off, *_split(raw, off)) if any(plain) else ())
        return [next(together) if p else self.encode(t) for t, p in zip(texts, plain)]

    def decode(self, ids: bytes) -> str:
        """The text of such ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _opened(path: str) -> ByteBPE:
    """One a worker: the automaton takes a while to build."""
    return held(("bpe", path), lambda: ByteBPE(path))


def _chunks(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    sizes = pc.binary_length(column.cast(pa.large_binary()).fill_null(b"")).to_numpy()
    lo = 0
    for hi in [*(np.flatnonzero(np.diff(np.cumsum(sizes) // size)) + 1).tolist(), len(sizes)]:
        if hi > lo:
            yield lo, hi
        lo = hi


def _mapped(df: DataFrame, source: str, fields: list[T.StructField], columns) -> DataFrame:
    kept = [c for c in df.columns if c.lower() not in {f.name for f in fields}]
    df = df.select(*named(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(source)
            for lo, hi in _chunks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns(part.column(at).to_pylist())], names=[*kept, *[f.name for f in fields]])

    return map_rows(df, run, T.StructType([*df.schema.fields, *fields]))


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens``; same-named columns are replaced.

    A null text is an empty one and has no ids.  Strings of added tokens in a text are those tokens.  Every row stands
    alone, so ties, repeated rows and order don't matter and an empty table gives no rows; work on a text is linear in
    its length but for the longest token, and a very long text is coded whole, alone in its batch.  Columns of any other
    names pass through.
    """

    def columns(texts: list) -> list[pa.Array]:
        bpe = _opened(tokenizer)
        ids = bpe.encode_all([t or "" for t in texts])
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return _mapped(docs, text, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], columns)


def decode(docs: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of ``ids`` as :func:`encode` gives them (null: empty); a column of that name is replaced.

    Rows stand alone: repeated rows are decoded each, an empty table gives no rows.
    """

    def columns(values: list) -> list[pa.Array]:
        bpe = _opened(tokenizer)
        return [pa.array([bpe.decode(v or b"") for v in values], pa.string())]

    return _mapped(docs, ids, [T.StructField("decoded", T.StringType())], columns)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, encoded and decoded: adds ``ids``, ``n_tokens`` and ``decoded``."""
    return decode(encode(docs, tokenizer, text).drop(F.col(text)), tokenizer)
