"""Similarity join on word n-grams by vertical partitioning.

First, the smallest hashes of each set show which classes can have a partner at all; only theirs are sent whole.
The n-grams of all documents have one global order: by frequency class (powers of two), then by hash.  The order is
cut into fragments; the part of a document's set that falls in a fragment is a segment.  Candidates arise within
fragments, where segments share an n-gram of the sets' prefixes; the overlaps of a pair are counted segment by
segment, apart from each other, and summed by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import components, partitions, scratch
from plumbline.llm.packing import binaries, buckets_for, flat, pack, unpack
from plumbline.llm.wordhash import by_bytes, mix, windows, words_of

#: The global order is cut into so many fragments: n-grams in 2-3, 4-7 and so on classes; the last holds the rest.
_FRAGMENTS = 4
#: At most so many rounds in which classes meet a few leads of their n-grams, before all pairs are tried that are apart;
#: it only decides how many pairs are tried, not which links are found.
_ROUNDS = 6
#: Leads of an n-gram and size range in a round.
_LEADS = 8
#: A set's parity map has so many bits (64 in a long).
_BITS = 1024
#: Classes of a hot n-gram meet in blocks of about so many.
_BLOCK = 2048
#: An n-gram of more than one in so many documents is counted as hot beforehand.
_HOT = 512
#: Grams of a group of classes in memory at once.
_SLICE = 131_072
#: Partners share one in so many n-grams of a set, at least, among the smallest hashes of both.
_SHARE = 10
#: Bits of the map of classes that can have a partner; with more classes than it is made for, some are sent in vain.
_MAP = 1 << 25


def _sets(texts: pa.Array, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct shingles of each text, ascending, and a fingerprint of each set (0: empty)."""
    _, _, h, rows = words_of(texts, lower=True)
    w, ok = windows(h, rows, words)
    sets, prints = [], np.zeros(len(texts), dtype=np.uint64)
    for i in range(len(texts)):
        a, b = int(rows[i]), int(rows[i + 1])
        if b - a >= words:
            s = np.unique(w[a : b - words + 1])
        elif b > a:
            s = windows(h[a:b], np.array([0, b - a]), b - a)[0][:1] + np.uint64(b - a)
        else:
            s = h[:0]
        sets.append(s)
        if len(s):
            prints[i] = mix(np.sum(mix(s + np.uint64(0x51ED270B)), dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0] | np.uint64(1)
    return sets, prints


def _map_of(classes: DataFrame, rows: int) -> np.ndarray:
    """A map of bits, two of which are set for each of ``rows`` classes."""
    bits = min(_MAP, 1 << max(10, (16 * rows).bit_length()))
    spots = classes.select(F.explode(F.array(*[F.shiftrightunsigned("class", s).bitwiseAND(F.lit(bits - 1)) for s in (8, 36)])).alias("bit"))
    words = spots.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint64)


def _in_map(bits: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which classes the map may hold; those that it holds are always among them."""
    inside = np.ones(len(classes), dtype=bool)
    for s in (8, 36):
        bit = (classes >> np.uint64(s)) & np.uint64(64 * len(bits) - 1)
        inside &= (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return inside


def _least(n: np.ndarray | int, percent: int) -> np.ndarray:
    """Of sets of ``n`` n-grams, the k smallest common ones with any partner that :func:`_prefix` holds for both sets,
    if the partner has ``n`` too; it never falls as ``n`` grows."""
    return np.maximum(1, np.minimum(n // _SHARE, -(-percent * n // 100)))


def _prefix(n: np.ndarray | int, percent: int) -> np.ndarray:
    """How many of a set's smallest hashes are looked at: a partner lacks at most n - need of the n, so the k smallest
    common ones are among the first n - need + k of either set."""
    return np.minimum(n, n - -(-percent * n // 100) + _least(n, percent))


def shingle_join(docs: DataFrame, text: str = "text", record: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """Rows ``doc_id``, ``n_shingles``, ``class_id``, ``component_id`` for every document (ids by ``record``'s name).

    A document's set holds its distinct shingles of ``words`` lower-cased (A-Z) words; a shorter document's is its
    whole word sequence, one without words has an empty set and is linked with nothing.  Documents link where
    100 * intersection >= percent * union; ``component_id`` is the smallest id reachable by links.  Equal sets are
    one class (``class_id``, null for an empty set) and are compared once, so copies cost nothing.  Pairs within one
    known component aren't verified again.  A null id takes part by its text and is never a ``component_id`` unless
    alone.  Repeated rows are copies.  A very long text is hashed whole, alone in its batch: memory follows the longest
    text.  Other columns aren't looked at, so their names can't clash.  An empty table gives no rows.

    N-grams that a slice of documents shows to be in more than one of ``_HOT`` of them are counted by sums beforehand and
    sent to their classes directly, so no task gets all classes of such an n-gram; there are at most _HOT times the
    mean set size of them, which is what is broadcast.

    A set is sent whole only if enough of its smallest hashes (some three in ten at 80 percent) are in other classes, as
    those of any partner are.  By a shuffle's many buckets every hash of a large corpus travels with its class alone, which
    takes up to three times its own bytes, so what is sent decides the disk.  The classes that are left are broadcast as
    a map of at most ``_MAP`` bits, which knows all of them and may take others for them.

    Shingles and classes are 64-bit hashes: among n different ones about n*n/2**65 pairs are confused.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(record).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Facts of documents, and rows without a size for the n-grams that many documents of a slice have."""
        for batch in by_bytes(batches, "text"):
            sets, prints = _sets(batch.column("text"), words)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(prints.view(np.int64), mask=n == 0)], names=["id", "n", "class"])
            own = np.unique(prints, return_index=True)[1]
            if len(own):
                grams, counts = np.unique(np.concatenate([sets[i] for i in own]), return_counts=True)
                often = counts >= max(8, len(own) / _HOT)
                k = int(often.sum())
                yield pa.RecordBatch.from_arrays([pa.array(counts[often].astype(np.int64)), pa.nulls(k, pa.int64()), pa.array(grams[often].view(np.int64))], names=["id", "n", "class"])

    facts = scratch(src.mapInArrow(described, "id long, n long, class long"), "sets")
    sets = facts.where("n is not null")
    total, rows = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = facts.where("n is null").groupBy(F.col("class").alias("gram")).agg(F.sum("id").alias("c")).where(F.col("c") > rows / (2 * _HOT))
    often = sorted((r["gram"], r["c"]) for r in often.collect())
    hot = spark.sparkContext.broadcast((np.array([g for g, _ in often], dtype=np.int64).view(np.uint64), np.array([c for _, c in often], dtype=np.uint32)))
    wanted = None  # the map of classes that can have a partner, once it is known

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-grams of ``wanted`` classes, or of every class the smallest."""
        grams = np.sort(hot.value[0])
        seen: set[int] = set()  # classes this task has sent; forgetting them would only send a copy twice
        for batch in by_bytes(batches, "text"):
            sets, prints = _sets(batch.column("text"), words)
            new, able = [], np.ones(len(prints), dtype=bool) if wanted is None else _in_map(wanted.value, prints)
            for i, p in enumerate(prints.tolist()):
                if p and able[i] and p not in seen:
                    seen.add(p)
                    new.append(i)
            if len(seen) > 500_000:
                seen.clear()
            if not new:
                continue
            sizes = np.array([len(sets[i]) for i in new], dtype=np.int64)
            sent = sizes if wanted is not None else _prefix(sizes, percent)
            values, who = np.concatenate([sets[i][:k] for i, k in zip(new, sent.tolist(), strict=True)]), np.repeat(np.arange(len(new)), sent)
            known = np.isin(values, grams)
            headers = {"class": prints[new], "n": sizes.astype(np.uint32)}
            # values by their own buckets, hot ones by those of their classes, which are numbered after these
            for take, key, base in ((~known, values, 0), (known, prints[new][who], buckets)):
                if take.any():
                    yield pack(values[take], who[take], buckets, headers, {}, key[take], base)

    def found_twice(key: tuple, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of one bucket, the shingles that two or more classes have, by class: class, shingle, size, number of classes."""
        x = unpack(table, {"class": "<u8", "n": "<u4"}, {})
        order = np.lexsort((x["class"], x["value"]))
        v, c, n = x["value"][order], x["class"][order], x["n"][order]
        first = np.ones(len(v), dtype=bool)
        first[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
        v, c, n = v[first], c[first], n[first]
        if key[0].as_py() < buckets:
            edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([edge, [len(v)]]))
            freq = np.repeat(sizes, sizes).astype(np.uint32)
        else:
            grams, counts = hot.value
            order = np.argsort(grams)
            freq = counts[order][np.searchsorted(grams[order], v)]
        keep = freq > 1
        v, c, n, freq = v[keep], c[keep], n[keep], freq[keep]
        order = np.argsort(c, kind="stable")
        return c[order], v[order], n[order], freq[order]

    def shared_number(key: tuple, table: pa.Table) -> pa.Table:
        """The classes that share shingles of one bucket, with their number."""
        c, _, n, _ = found_twice(key, table)
        c, at, k = np.unique(c, return_index=True, return_counts=True)
        return pa.table({"class": c.view(np.int64), "n": n[at].astype(np.int64), "k": k.astype(np.int64)})

    # every class's smallest shingles: those of partners meet there (``emit`` and the rest go to tasks with the values of
    # ``buckets`` and ``wanted`` at the time a plan is made)
    kind = "bucket int, value binary, count binary, class binary, n binary"
    buckets = buckets_for(int(total * _prefix(1000, percent) / 1000), partitions(spark))
    least = F.greatest(F.lit(1), F.least(F.floor(F.col("need") / _SHARE), F.ceil(F.col("need") * percent / 100)))
    hopeful = src.mapInArrow(emit, kind).groupBy("bucket").applyInArrow(shared_number, "class long, n long, k long").groupBy("class", "n").agg(F.sum("k").alias("k"))
    # a partner has at least ``need`` shingles, so both sets' prefixes hold as many common ones as are due to that size
    hopeful = scratch(hopeful.withColumn("need", F.ceil(F.col("n") * percent / 100)).where(F.col("k") >= least).select("class", "n"), "hopeful")
    total, rows = hopeful.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    wanted = spark.sparkContext.broadcast(_map_of(hopeful, rows))
    buckets = buckets_for(total, partitions(spark))
    packed = src.mapInArrow(emit, kind)

    def shared_only(key: tuple, table: pa.Table) -> pa.Table:
        """Of one bucket, the shingles that two or more classes have, with that number, by buckets of classes."""
        c, v, n, freq = found_twice(key, table)
        edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        who = np.repeat(np.arange(len(edge)), np.diff(np.concatenate([edge, [len(c)]]))) if len(c) else edge
        return pa.Table.from_batches([pack(v, who, buckets, {"class": c[edge], "n": n[edge]}, {"freq": freq}, c)])

    kind = "bucket int, value binary, count binary, class binary, n binary, freq binary"
    shared = packed.groupBy("bucket").applyInArrow(shared_only, kind)
    segment = T.StructType([T.StructField("f", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    schema = T.StructType([*[T.StructField(x, T.LongType()) for x in ("class", "n", "alone", "prefix")], T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("segments", T.ArrayType(segment))])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Order the shared shingles of a bucket's classes and keep the classes that can have a partner."""
        from pyspark.sql.pandas.types import to_arrow_schema

        x = unpack(pa.Table.from_batches(batches), {"class": "<u8", "n": "<u4"}, {"freq": "<u4"})
        level = np.log2(x["freq"]).astype(np.int32)
        order = np.lexsort((x["value"], level, x["class"]))
        cls, grams, level, n = x["class"][order], x["value"][order], level[order], x["n"][order].astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.zeros(0, np.int64)
        ends = np.concatenate([edge[1:], [len(cls)]]) if len(cls) else edge
        have, size = ends - edge, n[edge]
        need = -(-percent * size // 100)
        at = np.flatnonzero(have >= need)
        fragment, signed = np.minimum(level, _FRAGMENTS), grams.view(np.int64)
        rows, held = [], 0
        for i in at.tolist():
            a, b = int(edge[i]), int(ends[i])
            alone = int(size[i] - have[i])
            cut = np.concatenate([[0], np.flatnonzero(np.diff(fragment[a:b])) + 1, [b - a]])
            parity = np.bincount((grams[a:b] >> np.uint64(40)).astype(np.int64) % _BITS, minlength=_BITS) & 1
            bits = np.packbits(parity.astype(np.uint8)).view(np.int64)
            parts = [{"f": int(fragment[a + s]), "at": int(s), "grams": signed[a + s : a + e]} for s, e in zip(cut[:-1], cut[1:], strict=True)]
            rows.append({"class": int(cls[a].view(np.int64)), "n": int(size[i]), "alone": alone, "prefix": max(0, int(size[i] - need[i]) + 1 - alone), "bits": bits, "segments": parts})
            held += b - a
            if held > _SLICE:
                yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    able = scratch(shared.groupBy("bucket").applyInArrow(ordered, schema), "candidates")
    segments = able.select("class", "n", F.explode("segments").alias("s")).select("class", "n", F.col("s.f").alias("f"), F.col("s.grams").alias("grams"))
    # in each fragment, the n-grams of a set's prefix and their places in the set's order: those found nowhere else come first
    inner = able.select("class", "n", "alone", "prefix", F.explode("segments").alias("s")).where("s.at < prefix")
    inner = inner.select("class", F.col("s.f").alias("f"), (F.col("alone") + F.col("s.at")).alias("from"), F.posexplode(F.slice("s.grams", F.lit(1), F.col("prefix").cast("int") - F.col("s.at"))).alias("place", "gram"))
    again = inner.groupBy("f", "gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    posts = inner.join(again.select("f", "gram"), ["f", "gram"]).select("f", "gram", "class", (F.col("from") + F.col("place")).alias("at"))
    maps = able.select("class", "n", "alone", "bits")
    posts = scratch(posts.join(maps, "class").select("f", "gram", "class", "at", "n", (F.col("n") - F.col("alone")).alias("m"), *[F.col("bits")[i].alias(f"b{i}") for i in range(_BITS // 64)]), "posts")

    def verified(pairs: DataFrame) -> DataFrame:
        left = segments.select(F.col("class").alias("a"), F.col("n").alias("na"), "f", F.col("grams").alias("ga"))
        right = segments.select(F.col("class").alias("b"), F.col("n").alias("nb"), "f", F.col("grams").alias("gb"))
        partial = pairs.join(left, "a").join(right, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("o"))
        summed = partial.groupBy("a", "b").agg(F.sum("o").alias("o"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        return summed.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")

    def side(rows: DataFrame, name: str) -> DataFrame:
        """Columns ``class``, ``n`` and so on by the name ``name``, beside the join's keys."""
        return rows.select(*[F.col(x).alias(name if x == "class" else name + x) if x not in ("f", "gram", "z", "block") else F.col(x) for x in rows.columns])

    def near() -> Column:
        """Whether ``a`` and ``b`` can reach the threshold: by their sizes, by the places of the n-gram they share (of
        the first one, the overlap is no more than what either set has from there on; later the bound is lower still)
        and by their parity maps (the bits in which these differ are at most the n-grams in which the sets do)."""
        apart = sum((F.bit_count(F.col(f"ab{i}").bitwiseXOR(F.col(f"bb{i}"))) for i in range(1, _BITS // 64)), F.bit_count(F.col("ab0").bitwiseXOR(F.col("bb0"))))
        enough = lambda most: (100 + percent) * most >= percent * (F.col("an") + F.col("bn"))
        return (F.col("acomponent") != F.col("bcomponent")) & enough(F.col("an") - F.col("aat")) & enough(F.col("bn") - F.col("bat")) & ((100 + percent) * (F.col("am") + F.col("bm") - apart) >= 2 * percent * (F.col("an") + F.col("bn")))

    def now(found: DataFrame | None) -> DataFrame:
        if found is None:
            return posts.withColumn("component", F.col("class"))
        return posts.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))

    # First, rounds in which every class meets a few leads of its n-grams.  Leads and size ranges change by round, and
    # classes in one component don't meet again, so a large group of near copies comes together by about as many pairs
    # as it has classes.
    every, found = None, None
    for r in range(_ROUNDS):
        state = now(found).withColumn("z", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 0.5 * (r % 2)))
        split = state.groupBy("f", "gram", "z").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("f", "gram", "z")
        state = scratch(state.join(split, ["f", "gram", "z"]), "state")
        first = Window.partitionBy("f", "gram", "z").orderBy(F.xxhash64("class", F.lit(r)))
        leads = state.withColumn("k", F.row_number().over(first)).where(F.col("k") <= _LEADS).drop("k")
        stars = scratch(side(state, "a").join(side(leads, "b"), ["f", "gram", "z"]).where(near()).select("a", "b").distinct(), "stars")
        new = scratch(verified(stars), "links", stars.count())
        if not (linked := new.count()):
            break
        every = new if every is None else every.unionByName(new)
        found = scratch(components(every), "components", 2 * every.count())
        if 10 * linked < found.count():  # what is left apart is mostly so by its texts
            break
    # then all pairs of an n-gram's classes that aren't in one component yet, a hot n-gram's by blocks of classes
    rest = now(found)
    split = rest.groupBy("f", "gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("f", "gram", F.ceil(F.col("c") / _BLOCK).cast("int").alias("blocks"))
    rest = scratch(rest.join(split, ["f", "gram"]), "open")
    one = side(rest.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).drop("blocks"), "a")
    two = side(rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"), "b")
    cross = one.join(two, ["f", "gram", "block"]).where((F.col("a") < F.col("b")) & near()).select("a", "b").distinct()
    more = scratch(verified(cross), "links")
    if found is None or not more.isEmpty():
        found = scratch(components(more if every is None else every.unionByName(more)), "components")
    # back to documents: the class's smallest id, then the component's
    classes = sets.where("class is not null").groupBy("class").agg(F.min("id").alias("class_id"))
    classes = classes.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    classes = scratch(classes, "classes")
    lowest = classes.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = classes.join(lowest, "component").select("class", "class_id", "component_id")
    return sets.join(named, "class", "left").select(F.col("id").alias(record), F.col("n").alias("n_shingles"), "class_id", F.coalesce("component_id", "id").alias("component_id"))
