"""WARC archives as seekable Zstandard bundles: independent frames, a footer with their sizes, and places of records.

A bundle is one file.  Its data frames hold whole WARC records and can be decompressed one by one.  After them come a
skippable frame with the place of each record (number of its frame, offset and length in what the frame holds) and the
seek table of the public seekable format (compressed and decompressed size and checksum of each frame).  Any Zstandard
decoder reads a bundle from end to end as plain WARC.

Spark's own text writer makes the files, so they are committed, retried and stored as any other output.  It writes a row's
bytes as they are and a line separator after each; the separator is three bytes that end the footer's magic number.  So
every other row ends with the head of a skippable frame of three bytes, which the separator fills.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import scratch, spare
from plumbline.llm.wordhash import by_bytes

#: Fixed values of the seekable format: magic numbers of skippable frames and of the footer.
_PAD, _PLACES, _TABLE, _FOOTER = 0x184D2A50, 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: The last three bytes of the footer, which are one character in UTF-8.
_END = struct.pack("<I", _FOOTER)[1:]
_CHECKED = 0x80
_HEAD = struct.Struct("<II")
_ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("check", "<u4")])
_PLACE = np.dtype([("id", "V16"), ("nameless", "u1"), ("key", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
#: Fixed values of WARC: the profile of revisits, and the media type of what was served.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEDIA = "application/http;msgtype=response"
_NO_CONTROLS = {c: f"%{c:02X}" for c in (*range(0x21), 0x7F)}


def record_id(key: int | None, digest: str) -> uuid.UUID:
    """The identifier of a record: the same for equal keys and payloads only."""
    return uuid.UUID(bytes=hashlib.sha256(f"{key}|{digest}".encode()).digest()[:16], version=5)


def _record(kind: str, key: int | None, url: str | None, digest: str, date: str, payload: bytes, refers: uuid.UUID | None) -> tuple[uuid.UUID, bytes]:
    name = record_id(key, digest)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.translate(_NO_CONTROLS)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if key is not None:
        lines.append(f"X-Key: {key}")
    if refers is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers}>"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    lines += [f"Content-Type: {_MEDIA}", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Writer:
    """The rows of one bundle, of which each but the last ends with the head of a skippable frame."""

    def __init__(self, level: int):
        self.codec = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[bytes] = []
        self.size = self.rows = self.packed = 0
        self.table: list[tuple[int, int, int]] = []
        self.places: list[tuple] = []

    def add(self, name: uuid.UUID, key: int | None, record: bytes) -> None:
        self.places.append((name.bytes, key is None, key or 0, len(self.table), self.size, len(record)))
        self.held.append(record)
        self.size += len(record)

    def _entry(self, packed: int, raw: bytes = b"") -> None:
        self.table.append((packed, len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def frame(self) -> bytes:
        raw = b"".join(self.held)
        packed = self.codec.compress(raw)
        self._entry(len(packed), raw)
        self._entry(_HEAD.size + len(_END))
        self.held, self.size = [], 0
        self.rows, self.packed = self.rows + 1, self.packed + len(packed)
        return packed + _HEAD.pack(_PAD, len(_END))

    def ending(self, rows: int = 0) -> list[bytes]:
        """The last rows, with empty frames before them up to ``rows`` in all."""
        fill = max(0, rows - 2 - self.rows)
        for _ in range(fill):
            self._entry(_HEAD.size + len(_END))
        places = np.array(self.places, dtype=_PLACE).tobytes()
        self._entry(_HEAD.size + len(places) + len(_END))
        table = np.array(self.table, dtype=_ENTRY).tobytes() + struct.pack("<IBI", len(self.table), _CHECKED, _FOOTER)
        return [*[_HEAD.pack(_PAD, len(_END))] * fill, _HEAD.pack(_PLACES, len(places) + len(_END)) + places, (_HEAD.pack(_TABLE, len(table)) + table)[: -len(_END)]]


class Bundle:
    """A bundle's bytes, read by frames."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        count, flags, magic = struct.unpack("<IBI", self.data[-9:])
        if magic != _FOOTER or flags != _CHECKED:
            raise ValueError("no seek table at the end of the bundle")
        top = len(data) - 9 - count * _ENTRY.itemsize
        if bytes(self.data[top - _HEAD.size : top]) != _HEAD.pack(_TABLE, len(data) - top):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(self.data[top:-9], _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])

    def places(self) -> np.ndarray:
        """A row a record: ``id``, ``key`` (unless ``nameless``), ``frame``, ``offset``, ``length``."""
        part = self.data[int(self.starts[-2]) : int(self.starts[-1])]
        return np.frombuffer(part[_HEAD.size : -len(_END)], _PLACE)

    def frame(self, number: int) -> bytes:
        """What one frame holds; no other is looked at."""
        entry = self.table[number]
        raw = zstandard.ZstdDecompressor().decompress(self.data[int(self.starts[number]) : int(self.starts[number + 1])], max_output_size=int(entry["raw"]))
        if len(raw) != entry["raw"] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {number} is damaged")
        return raw


def parse(record: memoryview | bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (by lower-case name) and payload of one WARC record."""
    record = bytes(record)
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    fields = {k.lower(): v for k, v in fields.items()}
    size = int(fields["content-length"])
    if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def plan(pages: DataFrame, payload: str = "html", record: str = "page_id", url: str = "url", least: int = 100) -> DataFrame:
    """``key``, ``url``, ``payload``, ``digest`` and ``first`` (of a revisit: the smallest key with its payload) of each row.

    Payloads of at least ``least`` bytes are grouped by their digests, with map-side combine; only those that repeat are
    joined back, so one payload in very many rows gathers nowhere.
    """
    text = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{record}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), text.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n"))
    groups = scratch(groups.where("n > 1 and low is not null").select("digest", "low"), "payloads")
    joined = rows.join(groups, "digest", "left")
    return joined.select("key", "url", "payload", "digest", F.when(~F.col("key").eqNullSafe(F.col("low")), F.col("low")).alias("first"))


def write(pages: DataFrame, path: str, payload: str = "html", record: str = "page_id", url: str = "url", least: int = 100, frame: int = 1 << 20, bundle: int = 128, level: int = 3, date: str = "1970-01-01T00:00:00Z", files: int | None = None) -> None:
    """Write a WARC record of each row of ``pages`` to bundles in the folder ``path``, one or more a partition.

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest key is a ``response``; the others are
    ``revisit`` records, which name it and have no payload.  Shorter payloads are all stored.  A null payload is an empty
    one, a null address is left out, spaces and control characters in addresses are escaped.  A row without a key can
    revisit one with a key, but isn't revisited.  Rows equal in key and payload give equal records with one identifier:
    all are responses where their key is the smallest.  Records of ``frame`` bytes together make a frame; a longer one
    is alone in its own.  A bundle has up to ``bundle`` frames, fewer if they are large, so files stay small enough to be read in
    one piece.  An empty table gives bundles without records.  Other columns aren't looked at, whatever their names.
    """
    rows = plan(pages, payload, record, url, least)
    if files:
        rows = rows.repartition(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(level)
        cell = lambda *rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])
        for batch in by_bytes(batches, "payload"):
            keys, urls, digests, firsts = (batch.column(n).to_pylist() for n in ("key", "url", "digest", "first"))
            bodies = batch.column("payload").cast(pa.large_binary())
            for key, address, digest, first, body in zip(keys, urls, digests, firsts, bodies):
                if first is None:
                    name, data = _record("response", key, address, digest, date, body.as_py(), None)
                else:
                    name, data = _record("revisit", key, address, digest, date, b"", record_id(first, digest))
                if out.held and out.size + len(data) > frame:
                    yield cell(out.frame())
                    if out.rows == bundle or out.packed > bundle * frame:
                        for row in out.ending(bundle + 2):
                            yield cell(row)
                        out = _Writer(level)
                out.add(name, key, data)
        if out.held:
            yield cell(out.frame())
            for row in out.ending():
                yield cell(row)

    cells = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    cells.write.option("lineSep", _END.decode()).option("compression", "none").option("maxRecordsPerFile", bundle + 2).text(path)


_RECORD = "record_id string, key long, record_type string, url string, digest string, refers string, payload binary, file string, frame long, offset long, length long"


def _rows(file: str, bundle: Bundle, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The records at ``places``, a batch a frame."""
    cut = np.flatnonzero(np.diff(places["frame"])) + 1
    for part in np.split(places, cut) if len(places) else ():
        number = int(part["frame"][0])
        raw = memoryview(bundle.frame(number))
        found = [parse(raw[o : o + n]) for o, n in zip(part["offset"].tolist(), part["length"].tolist())]
        plain = lambda field: [f[field].removeprefix("<urn:uuid:").removesuffix(">") if field in f else None for f, _ in found]  # noqa: B023, E731
        columns = [
            pa.array(plain("warc-record-id")), pa.array([int(f["x-key"]) if "x-key" in f else None for f, _ in found], pa.int64()), pa.array(plain("warc-type")), pa.array(plain("warc-target-uri"), pa.string()),
            pa.array([f["warc-payload-digest"].removeprefix("sha256:") for f, _ in found]), pa.array(plain("warc-refers-to"), pa.string()), pa.array([p for _, p in found], pa.binary()), pa.array([file] * len(part)),
            pa.array(part["frame"].astype(np.int64)), pa.array(part["offset"].astype(np.int64)), pa.array(part["length"].astype(np.int64)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RECORD.split(", ")])


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Bundle]]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            data = content.as_buffer() if content.is_valid else b""
            if len(data):
                yield path.as_py(), Bundle(data)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles in ``path``: ``record_id``, ``key``, ``record_type``, ``url``, ``digest`` (hex SHA-256), ``refers`` (the
    identifier that a revisit names), ``payload`` (empty for revisits), ``file``, ``frame``, ``offset``, ``length``.  Sizes and checksums are
    verified; frames are decompressed one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, bundle in _bundles(batches):
            yield from _rows(file, bundle, bundle.places())

    return _files(spark, path).mapInArrow(run, _RECORD)


def index(spark: SparkSession, path: str) -> DataFrame:
    """Where each record is: ``record_id``, ``key``, ``file``, ``frame``, ``offset``, ``length``; no data frame is decompressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, bundle in _bundles(batches):
            p = bundle.places()
            names = [str(uuid.UUID(bytes=bytes(x))) for x in p["id"]]
            keys = pa.array(p["key"], mask=p["nameless"].astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), keys, pa.array([file] * len(p), pa.string()), *(pa.array(p[c].astype(np.int64)) for c in ("frame", "offset", "length"))], names=["record_id", "key", "file", "frame", "offset", "length"])

    return _files(spark, path).mapInArrow(run, "record_id string, key long, file string, frame long, offset long, length long")


def fetch(spark: SparkSession, places: DataFrame, records: list[str]) -> DataFrame:
    """The records with these identifiers, as :func:`read` gives them, by an :func:`index` (or a table of it): only their
    files are read and only their frames decompressed.  Identifiers that aren't there give nothing; of equal records
    each comes."""
    wanted = places.where(F.col("record_id").isin(records)).select("file", "frame", "offset", "length").collect()  # as many as were asked for
    at: dict[str, list] = {}
    for r in wanted:
        at.setdefault(r["file"], []).append((b"", 0, 0, r["frame"], r["offset"], r["length"]))
    if not at:
        return spark.createDataFrame([], _RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, bundle in _bundles(batches):
            yield from _rows(file, bundle, np.array(sorted(at[file], key=lambda x: x[3:]), dtype=_PLACE))

    return _files(spark, list(at)).mapInArrow(run, _RECORD)


def resolve(records: DataFrame, record: str = "page_id") -> DataFrame:
    """Of every record that :func:`read` gave: ``record`` (its key), ``record_id``, ``record_type``, ``payload_bytes`` and ``payload_digest`` of its
    full payload, which a revisit takes from the record it names, and ``refers_to`` (that record's key; null for responses).

    Sizes and digests are of the payloads read, not of what the headers say.  The records are read once, now.  A revisit of
    a record that isn't there has nulls.
    """
    body = F.col("payload")
    facts = scratch(records.select("record_id", "key", "record_type", "refers", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest")), "warc")
    named = facts.where("refers is not null").select(F.col("refers").alias("record_id")).distinct()
    target = facts.where("record_type = 'response'").join(named, "record_id").groupBy("record_id").agg(*(F.first(c).alias(c) for c in ("key", "payload_bytes", "payload_digest")))
    target = scratch(target.select(F.col("record_id").alias("refers"), F.col("key").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")), "named")
    revisit = F.col("refers").isNotNull()
    name = spare(["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"], record)
    return facts.join(target, "refers", "left").select(
        F.col("key").alias(name), "record_id", "record_type",
        F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("full_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "refers_to",
    )
