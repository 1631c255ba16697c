"""Vectors compressed to short codes: product quantisation with a vantage-point tree over each part's codebook.

A vector's components become integers and are cut into parts; each part position has a codebook of integer entries.
A part's nearest entry is found by metric branch and bound: a tree node holds one entry (its vantage point), and the
least and largest distances from it to the entries inside and outside its median.  By the triangle inequality those
bound the distance of a part to each side.  Distances are integers; their roots are rounded outwards, and a side is left
out only if its bound is strictly above the best distance so far, so every entry that can win or tie is compared by
integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import map_rows, named, scratch, spare

#: Integers below this in magnitude keep squared distances and their sums over parts within 64 bits.
_NARROW = 2**27
#: Components from here on aren't coded.
_WIDEST = 2.0**80
#: Outward rounding of square roots and sums of distances, some times what double precision can lose.
_SLACK = 2.0**-48
_VALUES = 1 << 20


def _squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = points - entry
    return (gap * gap).sum(1)


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above the square roots."""
    root = np.sqrt(squares.astype(np.float64))
    return root * (1 - _SLACK), root * (1 + _SLACK)


@dataclass(frozen=True)
class Node:
    """A vantage point with both sides and the bounds of their distances from it, or a leaf of entries."""

    entries: tuple[int, ...]
    inside: Node | None = None
    outside: Node | None = None
    bounds: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)


def tree(codebook: np.ndarray, leaf: int = 4) -> Node:
    """The vantage-point tree of one codebook (entries by components)."""

    def build(ids: np.ndarray) -> Node:
        if len(ids) <= leaf:
            return Node(tuple(int(i) for i in ids))
        # the vantage point is the entry furthest from the first one: near the edge, so that both sides differ most
        point = int(ids[int(np.argmax(_squares(codebook[ids], codebook[ids[0]])))])
        rest = ids[ids != point]
        far = _squares(codebook[rest], codebook[point])
        order = np.argsort(far, kind="stable")
        near, away = order[: len(order) // 2], order[len(order) // 2 :]
        low, high = _roots(far)
        return Node((point,), build(rest[near]), build(rest[away]), (float(low[near].min()), float(high[near].max()), float(low[away].min()), float(high[away].max())))

    return build(np.arange(len(codebook)))


def nearest(root: Node, codebook: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each point: the index of its nearest entry (ties: the lower index) and the squared distance; and how many
    distances were taken in all."""
    best = np.full(len(points), -1, dtype=np.int64)
    least = np.zeros(len(points), dtype=points.dtype)
    taken = 0

    def compare(i: int, at: np.ndarray) -> np.ndarray:
        nonlocal taken
        taken += len(at)
        squares = _squares(points[at], codebook[i])
        win = (best[at] < 0) | (squares < least[at]) | ((squares == least[at]) & (i < best[at]))
        best[at[win]], least[at[win]] = i, squares[win]
        return squares

    def open_(at: np.ndarray, low: np.ndarray, high: np.ndarray, side: tuple[float, float]) -> np.ndarray:
        """Those of ``at`` that may find an entry as near as their best one among entries at such distances."""
        bound = np.maximum(low - side[1], side[0] - high)
        return bound <= _roots(least[at])[1]

    def visit(node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.inside is None:
            for i in node.entries:
                compare(i, at)
            return
        low, high = _roots(compare(node.entries[0], at))
        inner, outer = node.bounds[:2], node.bounds[2:]
        first = low <= (inner[1] + outer[0]) / 2  # these look inside first; the order changes only the work
        for one in (first, ~first):
            a, lo, hi = at[one], low[one], high[one]
            for child, side in ((node.inside, inner), (node.outside, outer)) if one is first else ((node.outside, outer), (node.inside, inner)):
                may = open_(a, lo, hi, side)
                visit(child, a[may])

    if len(codebook) and len(points):
        visit(root, np.arange(len(points)))
    return best, least, taken


def _whole(x: np.ndarray, wide: bool) -> np.ndarray:
    """floor(256 * x), as 64-bit integers or, ``wide``, as Python's."""
    down = np.floor(np.asarray(x, dtype=np.float64) * 256.0)
    if not wide:
        return down.astype(np.int64)
    return np.array([int(v) for v in down.ravel()], dtype=object).reshape(down.shape)


def _coded(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can be coded, and their components."""
    column = column.cast(pa.large_list(pa.float64()))
    values = pc.fill_null(column.values, float("nan")).to_numpy(zero_copy_only=False)
    off = column.offsets.to_numpy()
    ok = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False) & (np.diff(off) == size))
    x = values[off[ok][:, None] + np.arange(size)]
    fine = (np.abs(x) < _WIDEST / 256).all(1)  # false for NaN
    return ok[fine], x[fine]


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    step = max(1, _VALUES // max(1, size))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


@dataclass(frozen=True)
class Codebooks:
    """Entries by part position, each an array of entries by components; ``size`` is the length of the vectors."""

    entries: tuple[np.ndarray, ...]
    size: int
    wide: bool

    def digest(self) -> str:
        """Hex SHA-256 of all components by part, entry and position, in decimals with commas between."""
        return hashlib.sha256(",".join(str(int(v)) for part in self.entries for v in part.ravel()).encode()).hexdigest()

    def trees(self) -> list[Node]:
        return [tree(e) for e in self.entries]

    def assign(self, trees: list[Node], x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By part: its integers, the index of the nearest entry, and the squared distance."""
        width = self.size // len(self.entries)
        for n, (root, entries) in enumerate(zip(trees, self.entries)):
            part = _whole(x[:, n * width : (n + 1) * width], self.wide)
            index, squares, _ = nearest(root, entries, part)
            yield part, index, squares


def train(vectors: DataFrame, embedding: str = "embedding", record: str = "vec_id", parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks of the vectors: they start as the ``entries`` first rows' parts, and each round moves every entry to the
    floor of the mean of the parts that it is nearest to; an entry that none is nearest to stays.

    Rows come in the order of their ids, those of one id in the order of their components, rows without an id last.  The
    vectors' length is that of the first that has components, all finite, in a number that ``parts`` divides.  None without such a
    vector.  A round is one pass; tasks send sums by part, entry and position, which are added before the driver gets
    them, so what it holds doesn't grow with the rows.
    """
    x = F.col(f"`{embedding}`").cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < _WIDEST / 256)), F.lit(False))  # false for NaN
    rows = vectors.select(F.col(f"`{record}`").cast("long").alias("id"), x.alias("x")).where(fine & (F.size("x") > 0) & (F.size("x") % parts == 0))
    order = (F.col("id").asc_nulls_last(), F.col("x"))
    head = rows.orderBy(*order).limit(1).collect()
    if not head:
        return None
    size = len(head[0]["x"])
    rows = rows.where(F.size("x") == size)
    first = np.array([r["x"] for r in rows.orderBy(*order).limit(entries).collect()])
    wide = not rows.where(F.exists("x", lambda v: F.abs(v) >= _NARROW / 256)).isEmpty()
    width = size // parts
    books = Codebooks(tuple(_whole(first[:, n * width : (n + 1) * width], wide) for n in range(parts)), size, wide)
    for _ in range(rounds):
        books = _moved(rows.select("x"), books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    trees, count, width, wide = books.trees(), len(books.entries[0]), books.size // len(books.entries), books.wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = object if wide else np.int64
        sums = np.zeros((len(trees), count, width), dtype=kind)
        used = np.zeros((len(trees), count), dtype=np.int64)
        for batch in _slices(batches, books.size):
            _, x = _coded(batch.column("x"), books.size)
            for n, (part, index, _) in enumerate(books.assign(trees, x)):
                np.add.at(sums[n], index, part)
                used[n] += np.bincount(index, minlength=count)
        part, entry = np.nonzero(used)
        total = pa.array([str(int(v)) for v in sums[part, entry].ravel()]) if wide else pa.array(sums[part, entry].ravel())
        at = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part))]
        yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in at), pa.array(np.repeat(used[part, entry], width)), total], names=["part", "entry", "place", "used", "total"])

    found = rows.mapInArrow(run, f"part int, entry int, place int, used long, total {'string' if wide else 'long'}")
    found = found.groupBy("part", "entry", "place").agg(F.sum("used").alias("used"), F.sum(F.col("total").cast("decimal(38,0)" if wide else "long")).alias("total"))
    entries = [e.copy() for e in books.entries]
    for r in found.collect():  # a row a component of the codebooks
        entries[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["used"]
    return Codebooks(tuple(entries), books.size, wide)


def encode(vectors: DataFrame, books: Codebooks | None, embedding: str = "embedding", record: str = "vec_id") -> DataFrame:
    """Every vector that ``books`` can code with ``code`` (two hex digits a part, in order) and ``error`` (squared distance of its
    integers to the entries, over all parts; null beyond 64 bits).

    Rows whose vector is null, holds null or non-finite components (or components of 2**72 and more), or has another
    length than the codebooks are left out.  Other columns pass through, those named ``code`` or ``error`` are
    replaced.  Rows stand alone, so repeated rows are coded alike; without codebooks or rows there are none.
    """
    kept = [c for c in vectors.columns if c.lower() not in ("code", "error")]
    rows = vectors.select(*named(kept))
    trees = books.trees() if books else []
    x_ = spare(kept, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, books.size if books else 1):
            at = batch.schema.names.index(x_)
            ok, x = _coded(batch.column(at), books.size) if books else (np.zeros(0, np.int64), None)
            text = np.zeros((len(ok), 2 * len(trees)), dtype=np.uint8)
            error = np.zeros(len(ok), dtype=object if books and books.wide else np.int64)
            digits = np.frombuffer(b"0123456789abcdef", np.uint8)
            for n, (_, index, squares) in enumerate(books.assign(trees, x) if len(ok) else ()):
                text[:, 2 * n], text[:, 2 * n + 1] = digits[index >> 4], digits[index & 15]
                error += squares
            rest = batch.take(pa.array(ok)).columns
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * len(trees)), len(ok), [None, pa.py_buffer(text.tobytes())]).cast(pa.binary()).cast(pa.string()) if len(ok) else pa.array([], pa.string())
            over = pa.array([int(e) if e < 2**63 else None for e in error], pa.int64()) if error.dtype == object else pa.array(error)
            yield pa.RecordBatch.from_arrays([*rest[:at], *rest[at + 1 :], code, over], names=[*(c for c in batch.schema.names if c != x_), "code", "error"])

    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return map_rows(rows.withColumn(x_, F.col(f"`{embedding}`").cast("array<double>")), run, schema)


def compress(vectors: DataFrame, embedding: str = "embedding", record: str = "vec_id", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks | None]:
    """``record``, ``label``, ``code``, ``error`` and ``label_error`` (errors summed over equal labels, nulls together; null beyond 64 bits) of every
    vector that can be coded, and the codebooks.  See :func:`train` and :func:`encode` for order, ties, repeated rows and odd vectors.

    ``label_error`` is one aggregation joined back from a written table, so a label of most rows gathers nowhere.
    """
    books = train(vectors, embedding, record, parts, entries, rounds)
    names = vectors.select(F.col(f"`{record}`").alias("id"), F.col(f"`{label}`").alias("group"), F.col(f"`{embedding}`").alias("vector"))
    coded = scratch(encode(names, books, "vector", "id").select("id", "group", "code", "error"), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("group").agg(F.when(F.count("error") == F.count(F.lit(1)), total).cast("decimal(38,0)").alias("sum"))
    sums = scratch(sums.select(F.col("group").alias("g"), F.when(F.col("sum") <= 2**63 - 1, F.col("sum")).cast("long").alias("label_error")), "labels")
    out = coded.join(sums, coded["group"].eqNullSafe(sums["g"])).select(F.col("id").alias(record), F.col("group").alias(label), "code", "error", "label_error")
    return out, books
