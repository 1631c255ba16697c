"""Token-id output in ORC: run-length encoded integers, row indexes, Bloom filters on document ids.

Files hold ascending, disjoint ranges of document ids, so min/max statistics prune whole files and stripes, the row
index prunes within a stripe, and the Bloom filter answers point look-ups; each stripe can be read by its own task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import pieces
from plumbline.llm.common import scratch
from plumbline.llm.wordhash import flat_bytes

#: Pieces up to so many characters are remembered.
_LONG = 64
#: Fixed value: the tokenizer's split of lower-case text; :func:`_split` does the same to those characters.
_SPLITS_ALIKE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def _split(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's pieces in lower-case plain texts with offsets ``off``."""
    n = len(raw)
    kind, on = pieces.classes(raw)
    new = np.ones(n, dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == pieces.NUMBER) & ~on[1:])
    new[off[:-1][off[:-1] < n]] = True
    pieces.cut_endings(raw, off, new, np.flatnonzero((raw == ord("'")) & new))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)[: len(starts)]
    word = kind[starts] != pieces.SPACE
    return starts[word], ends[word]


class _Encoder:
    """Token ids of texts (little-endian 32-bit integers), remembering short pieces; needs a tokenizer for which the ids
    of a text are those of its space-separated pieces in turn (one that drops white space before it merges).

    Where the tokenizer composes, lower-cases and splits as :func:`_split` does, plain texts that spell no special token
    are split so, known by 64-bit hashes and put together in whole slices; other texts are cut at ASCII white space."""

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        from plumbline.llm.bpe import byte_letters

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        first, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.splits = steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": _SPLITS_ALIKE} and [x["type"] for x in rest] == ["ByteLevel"]
        letters, model = str.maketrans({chr(b): c for c, b in byte_letters().items()}), self.tokenizer.model
        self.memory = pieces.Memory(lambda new: [[t.id for t in model.tokenize(w.decode("latin-1").translate(letters))] for w in new], most)
        self.known: dict[str, bytes] = {}
        self.most = most

    def plain(self, texts: list[str]) -> list[bytes]:
        raw, off = flat_bytes(pc.utf8_lower(pa.array(texts, pa.large_string())))
        return self.memory.codes(raw, off, *_split(raw, off))

    def other(self, texts: list[str]) -> list[bytes]:
        words = [_SPACES.split(t) for t in texts]
        known = self.known
        if len(known) > self.most // 5:
            known.clear()
        new = [w for w in set().union(*words) if w not in known]
        for lo in range(0, len(new), 5_000):
            part = new[lo : lo + 5_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, dtype="<i4").tobytes()
        out = [b"".join(map(known.__getitem__, ws)) for ws in words]
        for w in new:
            if len(w) > _LONG:
                del known[w]
        return out

    def _is_plain(self, text: str) -> bool:
        return pieces.PLAIN.fullmatch(text) is not None and ("<" not in text or not any(s in text.lower() for s in self.special))

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [self.splits and self._is_plain(t) for t in texts]
        one = iter(self.plain([t for t, p in zip(texts, plain) if p]) if any(plain) else ())
        two = iter(self.other([t for t, p in zip(texts, plain) if not p]) if not all(plain) else ())
        return [next(one if p else two) for p in plain]


_OPEN: dict[str, _Encoder] = {}


def _opened(path: str) -> _Encoder:
    """One a worker."""
    if path not in _OPEN:
        _OPEN[path] = _Encoder(path)
    return _OPEN[path]


def encode(docs: DataFrame, tokenizer: str, end: int | None = 2, text: str = "text", record: str = "doc_id", chunk: int = 1 << 20) -> DataFrame:
    """Rows ``doc_id`` (as ``record`` is named) and ``tokens`` (array of int) with ``end`` appended to each.

    A null text is an empty one.  ``tokenizer`` is the path of a ``tokenizers`` JSON file that every executor has.  Rows
    stand alone: repeated rows are coded each, an empty table gives no rows, a very long text is coded whole, alone in
    its slice, and other columns aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _opened(tokenizer)
        tail = b"" if end is None else np.array([end], dtype="<i4").tobytes()
        for batch in batches:
            lo = 0
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            sizes = pc.binary_length(texts).to_numpy()
            edges = np.flatnonzero(np.diff(np.cumsum(sizes) // chunk)) + 1
            for hi in [*edges, len(texts)]:
                if hi == lo:
                    continue
                ids = [x + tail for x in encoder(texts.slice(lo, hi - lo).to_pylist())]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))], names=["id", "tokens"])
                lo = hi

    out = docs.select(F.col(record).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))]))
    return out.withColumnRenamed("id", record)


def write_documents(docs: DataFrame, tokenizer: str, path: str, end: int | None = 2, text: str = "text", record: str = "doc_id", stripe_mb: int = 16, files: int | None = None) -> None:
    """:func:`encode` and :func:`write` in one: texts are dealt into ranges of ids before they are encoded, so finding
    the ranges doesn't encode anything."""
    ranged = docs.select(record, text)
    ranged = ranged.repartitionByRange(files, record) if files else ranged.repartitionByRange(record)
    write(encode(ranged, tokenizer, end, text, record), path, record, stripe_mb, ranged=True)


def write(tokens: DataFrame, path: str, record: str = "doc_id", stripe_mb: int = 16, files: int | None = None, ranged: bool = False) -> None:
    """Write ``record``, ``tokens`` as ORC in ascending order of ids, over all files by name (null ids first).

    Rows with equal ids go to one file, ordered by their tokens.  An empty table gives no data files.  ``ranged`` says
    that the partitions hold ascending ranges of ids already.
    """
    rows = tokens.select(record, "tokens")
    if not ranged:
        rows = rows.repartitionByRange(files, record) if files else rows.repartitionByRange(record)
    (
        rows.sortWithinPartitions(record, "tokens")
        .write.option("orc.bloom.filter.columns", record)
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.encoding.strategy", "COMPRESSION")
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str, record: str = "doc_id", ids: list[int] | None = None) -> DataFrame:
    """The rows of the files with the name of their file; with ``ids`` only those, by statistics and Bloom filters."""
    schema = T.StructType([T.StructField(record, T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    rows = spark.read.schema(schema).orc(path)
    if ids is not None:
        rows = rows.where(F.col(record).isin(ids))
    return rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def layout(rows: DataFrame, record: str = "doc_id") -> DataFrame:
    """What :func:`read` gave, as ``record``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Each task takes counts and checksums of the rows it reads; totals by file, one small row each, place the files, in
    the order of their smallest ids (null ids are in the first).  Repeated rows have places one after another.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            offsets = lists.offsets.to_numpy()
            flat = np.ascontiguousarray(lists.values.to_numpy().astype("<u4"))
            crc = np.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("file"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc)], names=["id", "file", "n", "crc"])

    facts = scratch(rows.select(F.col(record).alias("id"), "file", "tokens").mapInArrow(digest, "id long, file string, n long, crc long"), "layout")
    before = Window.orderBy(F.desc("nameless"), F.asc_nulls_first("low"), "file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = facts.groupBy("file").agg(F.sum("n").alias("n"), F.min("id").alias("low"), F.bool_or(F.col("id").isNull()).alias("nameless")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("file").orderBy("id", "n", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return facts.withColumn("upto", F.sum("n").over(own)).join(files, "file").select(F.col("id").alias(record), (F.col("base") + F.col("upto") - F.col("n")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
