"""Hashes packed for the shuffle: a task's 64-bit values go out as one binary row for each bucket of values.

Plain rows would carry some thirty bytes around each eight-byte hash.  A packed row holds, for one task and bucket,
the values in document order, the key of each document with its count of values, and further columns in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def buckets_for(values: int, partitions: int, per_bucket: int = 1_000_000) -> int:
    """Enough buckets for every shuffle partition to get some, each of about ``per_bucket`` values at most."""
    return max(2 * partitions, -(-values // per_bucket))


def binaries(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """values[starts[i]:ends[i]] as binary cells; the slices follow one another without gaps."""
    offsets = np.concatenate([starts[:1], ends]).astype(np.int64) * values.itemsize if len(starts) else np.zeros(1, np.int64)
    data = np.ascontiguousarray(values).view(np.uint8).tobytes() if len(values) else b""
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def pack(values: np.ndarray, docs: np.ndarray, buckets: int, headers: dict[str, np.ndarray], columns: dict[str, np.ndarray], keys: np.ndarray | None = None, base: int = 0) -> pa.RecordBatch:
    """One row a bucket: ``bucket``, ``value``, ``count`` (by document), the ``headers`` of those documents
    (arrays by document number) and the ``columns`` (arrays in parallel with ``values``); ``docs`` ascends.  Buckets are
    those of the values, or of ``keys`` in parallel with them, numbered from ``base`` on."""
    bucket = (((values if keys is None else keys) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32) + np.int32(base)
    order = np.argsort(bucket, kind="stable")
    bucket, docs = bucket[order], docs[order]
    edge = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(bucket)]])
    if not len(bucket):
        starts = ends = np.zeros(0, np.int64)
    run = np.flatnonzero((np.diff(docs) != 0) | (np.diff(bucket) != 0)) + 1
    runs = np.concatenate([[0], run]) if len(docs) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([runs, [len(docs)]])).astype(np.uint32)
    rs, re = np.searchsorted(runs, starts), np.searchsorted(runs, ends)
    out = {"bucket": pa.array(bucket[starts] if len(starts) else np.zeros(0, np.int32)), "value": binaries(values[order], starts, ends), "count": binaries(counts, rs, re)}
    out |= {k: binaries(v[docs[runs]], rs, re) for k, v in headers.items()}
    out |= {k: binaries(v[order], starts, ends) for k, v in columns.items()}
    return pa.RecordBatch.from_pydict(out)


def flat(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """All cells of a binary column one after another, as numbers."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        c = c.cast(pa.large_binary())
        _, offsets, data = c.buffers()
        off = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1]
        if data is not None:
            parts.append(np.frombuffer(data, np.uint8)[off[0] : off[-1]])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)).view(dtype)


def unpack(table: pa.Table, headers: dict[str, str], columns: dict[str, str]) -> dict[str, np.ndarray]:
    """``value``, the headers repeated for each value, and the columns."""
    counts = flat(table.column("count"), "<u4")
    out = {"value": flat(table.column("value"), "<u8")}
    out |= {k: np.repeat(flat(table.column(k), t), counts) for k, t in headers.items()}
    return out | {k: flat(table.column(k), t) for k, t in columns.items()}
