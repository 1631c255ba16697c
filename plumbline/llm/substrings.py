"""Repeated long word spans across documents, by compacting a De Bruijn graph of word windows.

The edges of the graph are windows of ``window`` words; an edge's neighbours are the windows one word before and
after it.  Only windows that can repeat become edges: a window is looked up by the smallest of its ``anchor``-word
hashes (its minimiser), which equal windows share.  Edges that occur once fall away.  A nonbranching path of repeated
edges occurs as a whole wherever its first edge does, so it compacts to that first edge, its places and its length;
joins by first edge find each path's earliest place, and the source coordinates give the spans to remove elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import map_rows, named, partitions, scratch, spare
from plumbline.llm.packing import binaries, buckets_for, flat, pack, unpack
from plumbline.llm.wordhash import _POW, by_bytes, mix, windows, words_of

_SELF = np.uint64(0xA5A5A5A5A5A5A5A5)
_LAST = 2**63 - 1


def _prints(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A fingerprint of each row's word sequence (0: no words)."""
    out = np.zeros(len(rows) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(rows))
    if len(full):
        place = np.arange(len(h)) - np.repeat(rows[:-1], np.diff(rows))
        power = _POW[place % len(_POW)] + (place // len(_POW)).astype(np.uint64) * np.uint64(2)
        out[full] = mix(np.add.reduceat(h * power, rows[:-1][full])) | np.uint64(1)
    return out


def _minimisers(h: np.ndarray, rows: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest anchor hash of the window from each word on, whether there is such a window, and the anchors that
    are smallest in some window, marked where they start."""
    k, ok_k = windows(h, rows, anchor)
    left = np.repeat(rows[1:], np.diff(rows)) - np.arange(len(h))
    ok = left >= window
    low = k.copy()
    span = window - anchor
    for d in range(1, span + 1):
        if len(h) > d:
            low[:-d] = np.minimum(low[:-d], k[d:])
    chosen = np.zeros(len(h), dtype=bool)
    for d in range(span + 1):
        if len(h) > d:
            n = len(h) - d
            chosen[d:] |= ok[:n] & (low[:n] == k[d:])
    return low, ok, chosen & ok_k


def _key(record: str, text: str) -> Column:
    """What a row is looked up by: its id, or a hash of its text where it has none, so that rows without ids don't meet
    in one group.  An id may equal another row's hash: prints of word sequences tell rows of one key apart."""
    return F.coalesce(F.col(record).cast("long"), F.xxhash64(F.col(text).cast("string")))


def spans(docs: DataFrame, text: str = "text", record: str = "doc_id", window: int = 20, anchor: int = 10) -> tuple[DataFrame, DataFrame]:
    """Facts and spans to remove.

    Facts: ``id``, ``key`` (:func:`_key`), ``print`` (of the word sequence; 0 if there are no words), ``n_words``, ``first``
    (the smallest id with that sequence) for every row.  Spans: ``id``, ``print``, ``start``, ``end`` (words, end exclusive), which cover
    each word of a row that is first with its sequence and that lies in a window seen earlier: at a smaller id, or
    before in that row.  Rows that aren't first repeat a whole text, so all their windows are seen earlier.
    Null ids come last in the order; rows equal in id and words are one document; other rows with one id come in the
    order of their prints.  Window hashes have 64 bits: among n different ones about n*n/2**65 pairs are confused.
    """
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(record).cast("long"), F.lit(_LAST)).alias("id"), _key(record, text).alias("key"), F.col(text).cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            _, _, h, rows = words_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(_prints(h, rows).view(np.int64)), pa.array(np.diff(rows).astype(np.int64))], names=["id", "key", "print", "n_words"])

    facts = scratch(src.mapInArrow(describe, "id long, key long, print long, n_words long"), "facts")
    firsts = facts.groupBy("print", "n_words").agg(F.min("id").alias("first"))
    facts = scratch(facts.join(firsts, ["print", "n_words"]), "facts")
    total = facts.agg(F.sum("n_words")).first()[0] or 0
    few = buckets_for(total // 5, partitions(spark))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in by_bytes(batches, "text"):
            _, _, h, rows = words_of(batch.column("text"))
            prints = _prints(h, rows)
            k, _ = windows(h, rows, anchor)
            _, _, chosen = _minimisers(h, rows, window, anchor)
            vals, who, head = [], [], []
            for i in np.flatnonzero(np.diff(rows) >= window):
                if int(prints[i]) in seen:
                    continue
                seen.add(int(prints[i]))
                a, b = int(rows[i]), int(rows[i + 1])
                v, c = np.unique(k[a:b][chosen[a:b]], return_counts=True)
                for part, p in ((v, prints[i]), (v[c > 1], prints[i] ^ _SELF)):  # what repeats within a row counts as if in another
                    if len(part):
                        vals.append(part)
                        who.append(np.full(len(part), len(head)))
                        head.append(p)
            if len(seen) > 500_000:
                seen.clear()
            if vals:
                yield pack(np.concatenate(vals), np.concatenate(who), few, {"print": np.array(head, dtype=np.uint64)}, {})

    def repeated(table: pa.Table) -> pa.Table:
        x = unpack(table, {"print": "<u8"}, {})
        order = np.lexsort((x["print"], x["value"]))
        v, p = x["value"][order], x["print"][order]
        first = np.ones(len(v), dtype=bool)
        first[1:] = (v[1:] != v[:-1]) | (p[1:] != p[:-1])
        v, p = v[first], p[first]
        twice = np.zeros(len(v), dtype=bool)
        twice[1:] = v[1:] == v[:-1]
        twice[:-1] |= twice[1:]
        v, p = v[twice], p[twice]
        order = np.argsort(p, kind="stable")
        v, p = v[order], p[order]
        edge = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
        ends = np.concatenate([edge[1:], [len(p)]]) if len(p) else edge
        return pa.table({"print": pa.array(p[edge].view(np.int64)), "anchors": binaries(v, edge, ends)})

    hits = src.mapInArrow(anchors, "bucket int, value binary, count binary, print binary").groupBy("bucket").applyInArrow(repeated, "print long, anchors binary")
    own = facts.where("id = first").select("key", "print").distinct()
    hits = scratch(hits.join(own, "print").groupBy("key").agg(F.collect_list("anchors").alias("anchors"), F.collect_set("print").alias("prints")), "hits")
    many = buckets_for(total // 4, partitions(spark))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows whose minimiser repeats, with their neighbours and places."""
        for batch in by_bytes(batches, "text"):
            if not batch.num_rows:
                continue
            _, _, h, rows = words_of(batch.column("text"))
            prints = _prints(h, rows)
            lists = batch.column("anchors").flatten()
            known = np.unique(flat(lists, "<u8"))
            w, _ = windows(h, rows, window)
            low, ok, _ = _minimisers(h, rows, window, anchor)
            wanted = np.array([int(p) in set(s) for p, s in zip(prints.view(np.int64).tolist(), batch.column("prints").to_pylist())])
            number = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
            take = np.flatnonzero(ok & wanted[number] & np.isin(low, known))
            start = take - rows[:-1][number[take]]
            prev = np.where(start > 0, w[take - 1], np.uint64(0))
            more = np.minimum(take + 1, len(w) - 1) if len(w) else take
            nxt = np.where((more > take) & (number[more] == number[take]) & ok[more], w[more], np.uint64(0))
            if len(take):
                yield pack(w[take], number[take], many, {"id": batch.column("id").to_numpy(), "print": prints}, {"prev": prev, "next": nxt, "start": start.astype(np.uint32)})

    def marks(table: pa.Table) -> pa.Table:
        """Where nonbranching paths of repeated edges begin (with their first edge) and end."""
        x = unpack(table, {"id": "<i8", "print": "<u8"}, {"prev": "<u8", "next": "<u8", "start": "<u4"})
        order = np.lexsort((x["start"], x["print"], x["id"], x["value"]))
        x = {k: v[order] for k, v in x.items()}
        v = x["value"]
        same = np.ones(len(v), dtype=bool)  # repeated rows of one document send an edge twice
        same[1:] = (v[1:] != v[:-1]) | (x["id"][1:] != x["id"][:-1]) | (x["print"][1:] != x["print"][:-1]) | (x["start"][1:] != x["start"][:-1])
        x = {k: a[same] for k, a in x.items()}
        v = x["value"]
        edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([edge, [len(v)]]))
        if not len(edge):
            head = tail = np.zeros(0, dtype=bool)
        else:
            single = lambda a: (np.minimum.reduceat(a, edge) == np.maximum.reduceat(a, edge)) & (np.minimum.reduceat(a, edge) != 0)
            head, tail = (np.repeat(~single(x[k]) & (size > 1), size) for k in ("prev", "next"))
        onward = tail & (x["next"] != 0)
        part = lambda m, at, e, begins, ends: {"id": x["id"][m], "print": x["print"][m].view(np.int64), "at": (x["start"][m] + at).astype(np.int64), "edge": e[m].view(np.int64), "begins": np.full(int(m.sum()), begins), "ends": np.full(int(m.sum()), ends)}
        parts = [part(head, 0, v, True, False), part(onward, 1, x["next"], True, False), part(tail, 0, v, False, True)]
        return pa.table({k: np.concatenate([p[k] for p in parts]) for k in parts[0]})

    packed = src.where(F.length("text") > 0).join(hits, "key").mapInArrow(edges, "bucket int, value binary, count binary, id binary, print binary, prev binary, next binary, start binary")
    found = packed.groupBy("bucket").applyInArrow(marks, "id long, print long, at long, edge long, begins boolean, ends boolean")
    found = found.groupBy("id", "print", "at").agg(F.max(F.when(F.col("begins"), F.col("edge"))).alias("edge"), F.max("ends").alias("ends"))
    along = Window.partitionBy("id", "print").orderBy("at")
    nxt = F.lead(F.struct("at", "edge")).over(along)
    paths = found.withColumn("nxt", nxt).where("edge is not null")
    stop = F.when(F.col("ends") | F.col("nxt").isNull(), F.col("at")).when(F.col("nxt.edge").isNull(), F.col("nxt.at")).otherwise(F.col("nxt.at") - 1)
    paths = scratch(paths.select("edge", "id", "print", F.col("at").alias("start"), (stop - F.col("at") + 1).alias("length")), "paths")
    place = F.struct("id", "print", "start")
    # written, so that the join below has its own exchange and Spark can split an edge with very many places
    source = scratch(paths.groupBy("edge").agg(F.min(place).alias("source"), F.min("length").alias("shared"), F.count(F.lit(1)).alias("places")).where("places > 1"), "sources", paths.count())
    later = paths.join(source, "edge").where(place != F.col("source"))
    # all places of a path have one length; the shortest is what all of them surely share
    out = later.select("id", "print", "start", (F.col("start") + F.least("length", "shared") + window - 1).alias("end"))
    return facts, out


def remove_repeats(docs: DataFrame, text: str = "text", record: str = "doc_id", window: int = 20, anchor: int = 10) -> DataFrame:
    """Add ``n_words``, ``n_removed``, ``kept_text`` and ``removed`` (array of word spans) to ``docs``.

    ``kept_text`` holds the words that no earlier window covers, joined by single spaces (a null or empty text: none).
    Columns of these names are replaced, columns of any other names pass through.  Repeated rows (equal in id and words)
    are one document and are cut alike.  A very long text is worked on whole, alone in its batch.  An empty table gives
    no rows.  See :func:`spans` for order, ties and null ids.
    """
    own = {"n_words", "n_removed", "kept_text", "removed"}
    docs = docs.select(*named([c for c in docs.columns if c.lower() not in own]))
    facts, found = spans(docs, text, record, window, anchor)
    copies = facts.where((F.col("id") > F.col("first")) & (F.col("n_words") >= window)).select("key", "print", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")).distinct()
    nameless = facts.where((F.col("id") == _LAST) & (F.col("first") == _LAST)).select("key", "print").distinct()
    found = found.where(F.col("id") < _LAST).select(F.col("id").alias("key"), "print", "start", "end").unionByName(found.where(F.col("id") == _LAST).join(nameless, "print").select("key", "print", "start", "end"))
    key, cuts_ = spare(docs.columns, "key"), spare(docs.columns, "cut")
    cut = found.unionByName(copies).groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("print", "start", "end"))).alias(cuts_))
    joined = docs.withColumn(key, _key(record, text)).join(cut, key, "left").drop(key)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(span))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            at = batch.schema.names.index(text)
            texts = batch.column(at).cast(pa.large_string())
            cuts = batch.column(batch.schema.names.index(cuts_)).to_pylist()
            prints: dict[int, int] = {}
            touched = np.array([c is not None for c in cuts], dtype=bool)
            if touched.any():
                _, _, h, rows = words_of(texts.filter(pa.array(touched)))
                prints = dict(zip(np.flatnonzero(touched).tolist(), _prints(h, rows).view(np.int64).tolist()))
            n, gone, kept, removed = [], [], [], []
            for i, t in enumerate(texts):
                ws = (t.as_py() or "").encode().split()
                merged: list[list[int]] = []
                for c in cuts[i] or ():
                    if c["print"] == prints[i]:
                        if merged and c["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], c["end"])
                        else:
                            merged.append([c["start"], c["end"]])
                n.append(len(ws))
                gone.append(sum(b - a for a, b in merged))
                for a, b in reversed(merged):
                    del ws[a:b]
                kept.append(b" ".join(ws).decode())
                removed.append([{"start": a, "end": b} for a, b in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            rest = [c for c, name in zip(batch.columns, batch.schema.names) if name != cuts_]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, kind)], names=[*[x for x in batch.schema.names if x != cuts_], "n_words", "n_removed", "kept_text", "removed"])

    return map_rows(joined, apply, schema)
