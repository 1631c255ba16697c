"""Language identification by prediction by partial matching (PPM).

For every language a tree of byte contexts of orders 3, 2, 1 and 0 is counted on training text and frozen.  A byte
is coded in its longest context seen in that language, with an escape to the next shorter one where the byte is new
there (method C: a context with n counts and d different bytes gives a byte c/(n+d) and the escape d/(n+d)), and at
the end uniformly.  A document goes to the language whose trees give its whole text the shortest code.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import held, map_rows, named
from plumbline.llm.wordhash import Places, by_bytes, flat_bytes

_PAD = "   "
#: Language costs of bytes that are held at once: some arrays of a few MB in all, which a worker gives back.
_CELLS = 1 << 18
_UNIFORM = 8.0


@dataclass(frozen=True)
class PPM:
    """Frozen code lengths in bits of all 256 byte values; languages run along the last axis of the tables.

    ``triples`` and ``quads`` are the sorted contexts with their byte that some language has.  ``short[triple]`` is what
    a byte costs in the contexts of order 2 and less, ``escape3[triple]`` leaving the order-3 context; both have a last
    row of zeros for what isn't there, as has ``delta[quad]``, what a byte costs in its order-3 context beyond those two
    (negative: it is cheaper).  ``escape2[pair]`` is leaving an order-2 context and ``order1[pair]`` a byte's cost in the
    contexts of order 1 and 0.
    """

    languages: list[str]
    triples: np.ndarray
    quads: np.ndarray
    short: np.ndarray
    escape3: np.ndarray
    delta: np.ndarray
    escape2: np.ndarray
    order1: np.ndarray


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    return flat_bytes(pc.binary_join_element_wise(pa.scalar(_PAD, pa.large_string()), lower, pa.scalar("", pa.large_string())))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        for lang in pc.unique(batch.column("lang")):
            flat, off = _padded(batch.column("text").filter(pc.equal(batch.column("lang"), lang)))
            b = flat.astype(np.int64)
            code = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:] if len(b) > 3 else np.zeros(0, np.int64)
            inner = np.ones(len(code), dtype=bool)  # the last byte of a gram isn't padding
            for k in range(3):
                at = off[:-1] + k - 3
                inner[at[(at >= 0) & (at < len(code))]] = False
            grams, counts = np.unique(code[inner], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(grams)).cast(pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def train(labelled: DataFrame, max_bytes: int = 1 << 20) -> PPM | None:
    """Fit the trees on ``lang``, ``text`` rows without nulls in either; None if there are none.

    The fit uses a hash-chosen sample of about ``max_bytes`` bytes of text a language (all of it where there is less;
    texts longer than ``max_bytes`` don't take part), counted in the executors; only counts of byte quadruples, at
    most one for each sampled byte, reach the driver.  The number of languages is taken to be small (a label set).
    """
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null").where(F.octet_length("text").between(1, max_bytes))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not totals:
        return None
    draw = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_000)) / F.lit(1e6)
    rate = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(min(1.0, max_bytes / v)))])
    counts = rows.where(draw < rate[F.col("lang")]).mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return fit(counts["lang"].to_numpy(), counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64))


def _costs(seen: np.ndarray, context: np.ndarray, contexts: int, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Method C: what each byte costs that is counted ``seen`` times in its context, or else by ``below`` after an escape;
    and the escapes of all contexts (0 where nothing was seen)."""
    total, kinds = np.bincount(context, weights=seen, minlength=contexts), np.bincount(context[seen > 0], minlength=contexts)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
        return np.where(seen > 0, -np.log2(seen / (total + kinds)[context]), escape[context] + below), escape


def fit(lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> PPM | None:
    """The frozen tables for counts ``n`` of byte quadruples ``gram`` (first byte highest) in each ``lang``."""
    if not len(gram):
        return None
    languages = sorted({str(x) for x in lang})
    quads = np.unique(gram)
    triples = np.unique(np.concatenate([quads >> 8, quads & 0xFFFFFF]))
    last, context = np.searchsorted(triples, quads & 0xFFFFFF), np.searchsorted(triples, quads >> 8)
    m = len(languages)
    zeros = lambda rows: np.zeros((rows, m), dtype=np.float32)
    short, escape3, delta, escape2, order1 = zeros(len(triples) + 1), zeros(len(triples) + 1), zeros(len(quads) + 1), zeros(1 << 16), zeros(1 << 16)
    pairs = np.arange(1 << 16)
    for i, name in enumerate(languages):
        own = np.zeros(len(quads))
        own[np.searchsorted(quads, gram[lang == name])] = n[lang == name]
        byte = np.bincount(quads & 255, weights=own, minlength=256)
        cost0, _ = _costs(byte, np.zeros(256, dtype=np.int64), 1, np.full(256, _UNIFORM))
        cost1, _ = _costs(np.bincount(quads & 0xFFFF, weights=own, minlength=1 << 16), pairs >> 8, 256, cost0[pairs & 255])
        cost2, leave2 = _costs(np.bincount(last, weights=own, minlength=len(triples)), triples >> 8, 1 << 16, cost1[triples & 0xFFFF])
        cost3, leave3 = _costs(own, context, len(triples), cost2[last])
        order1[:, i], escape2[:, i], short[:-1, i], escape3[:-1, i] = cost1, leave2, cost2, leave3
        delta[:-1, i] = cost3 - (leave3[context] + cost2[last])
    return PPM(languages, triples, quads, short, escape3, delta, escape2, order1)


def _index(model: PPM, key: str) -> tuple[Places, Places]:
    """Hash tables of the triples and quadruples; once a worker."""
    return held(("langid", key), lambda: (Places(model.triples), Places(model.quads)))


def code_lengths(model: PPM, index: tuple[Places, Places], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text under each language, and the number of bytes coded."""
    triples, quads = index
    flat, off = _padded(texts)
    bits = np.zeros((len(texts), len(model.languages)))
    bounds = np.column_stack([off[:-1], off[:-1] + len(_PAD)]).reshape(-1)  # even places begin padding, odd ones text
    step = max(1 << 14, _CELLS // len(model.languages))
    for lo in range(0, len(flat), step):
        hi = min(lo + step, len(flat))
        b = flat[max(0, lo - 3) : hi].astype(np.int64)
        b = np.concatenate([np.zeros(3 - min(lo, 3), np.int64), b])
        pair = b[:-1] << 8 | b[1:]
        triple = pair[:-1] << 8 | b[2:]
        place = triples.find(triple)
        context, end = place[:-1], place[1:]
        cost = model.short[end]
        new = np.flatnonzero(end == len(model.triples))
        cost[new] = model.escape2[pair[1:-1][new]] + model.order1[pair[2:][new]]
        cost += model.escape3[context]
        cost += model.delta[quads.find(triple[:-1] << 8 | b[3:])]
        a, z = np.searchsorted(bounds, [lo, hi])
        cuts = np.unique(np.concatenate([[lo], bounds[a:z]]))
        sums = np.add.reduceat(cost, cuts - lo, axis=0, dtype=np.float64)
        at = np.searchsorted(bounds, cuts, side="right") - 1
        text = at % 2 == 1
        np.add.at(bits, at[text] // 2, sums[text])
    return bits, np.diff(off) - len(_PAD)


def identify(spark: SparkSession, docs: DataFrame, model: PPM | None, text: str = "text", evidence: int = 64) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``bits_per_byte`` to ``docs``; columns of these names are replaced.

    ``lang_pred`` is the language of the shortest code (ties: the first in order), ``und`` where the text is null or
    has no letter, or nothing was learned.  ``score`` is that language's share of probability when the code lengths
    are scaled to at most ``evidence`` bytes of text (0 for ``und``); ``bits_per_byte`` is its code length per byte
    (null for ``und``).  The tables that are broadcast have a fixed size besides rows for the triples and quadruples of
    bytes in the bounded training sample (a number a language in each).  Texts of any length are coded whole, a segment
    at a time.  Rows stand alone, so repeated rows get the same each; other columns pass through.  An empty table gives
    none.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "bits_per_byte")]
    docs = docs.select(*named(kept))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    shared = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex  # of this model here: workers outlive it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in by_bytes(batches, text):
            texts = batch.column(batch.schema.names.index(text)).cast(pa.large_string())
            known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = len(texts)
            lang, score, per = np.full(n, "und", dtype=object), np.zeros(n), np.full(n, np.nan)
            if model is not None and known.any():
                bits, size = code_lengths(model, _index(model, key), texts.filter(pa.array(known)))
                rate = bits / size[:, None]
                best = rate.argmin(1)
                low = rate[np.arange(len(rate)), best]
                odds = np.exp2(-(rate - low[:, None]) * np.minimum(size, evidence)[:, None])
                lang[known] = np.array(model.languages, dtype=object)[best]
                score[known] = 1 / odds.sum(1)
                per[known] = low
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(per, mask=~np.isfinite(per))], names=[*batch.schema.names, "lang_pred", "score", "bits_per_byte"])

    return map_rows(docs, run, schema)
