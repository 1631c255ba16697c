"""Tables for look-ups by any of several keys: files along a space-filling curve, with Bloom filters on ids.

One order serves one key.  Here each key's values are cut into ranks at their quantiles, and the bits of the ranks are
interleaved (a Z-order curve): a file holds a small box in the space of all keys, so the statistics of its columns prune
look-ups and ranges of each key.  A Bloom filter says which of the files left don't hold an id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The name of the curve's column while rows are dealt.
_PLACE = "_curve"


def curve_place(ranks: Sequence[Column], bits: int) -> Column:
    """The interleaved lowest ``bits`` bits of ``ranks``, the first rank's bit before the others' of its weight."""
    k, out = len(ranks), F.lit(0).cast("long")
    if k * bits > 63:
        raise ValueError("the bits of all keys don't fit a long")
    for b in range(bits):
        for i, r in enumerate(ranks):
            bit = F.shiftright(r.cast("long"), b).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, b * k + k - 1 - i))
    return out


def with_ranks(df: DataFrame, keys: Sequence[str], bits: int, error: float = 1e-3) -> tuple[DataFrame, list[str]]:
    """Add a rank below 2^``bits`` for each of the numeric ``keys``: how many of its quantiles a value reaches.

    Quantiles are approximate (to a share ``error`` of the rows), of one pass for all keys; they only decide the layout.
    Null and NaN are rank 0.  A value of many rows takes several quantiles, which leaves fewer ranks to the others.
    """
    many = 2**bits - 1
    values = df.select(*[F.col(f"`{k}`").cast("double").alias(f"k{i}") for i, k in enumerate(keys)])
    names = [f"_k{i}" for i in range(len(keys))]
    found = values.approxQuantile(values.columns, [j / many for j in range(1, many)], error)  # below 2^bits numbers a key
    out = df.withColumns({n: F.col(f"`{k}`").cast("double") for n, k in zip(names, keys)})
    ranks = [f"{n}_rank" for n in names]
    for name, rank, cuts in zip(names, ranks, found):
        inner = sorted({c for c in cuts if float("-inf") < c < float("inf")})
        splits = [float("-inf"), *inner, float("inf")]
        if len(splits) < 3:
            out = out.withColumn(rank, F.when(F.col(name).isNull() | F.isnan(name), 0).otherwise(1))
            continue
        # ``keep`` puts NaN into a bucket of its own behind all others and leaves null: here both are 0, and the others follow
        out = Bucketizer(splits=splits, inputCol=name, outputCol=rank, handleInvalid="keep").transform(out)
        out = out.withColumn(rank, F.coalesce((F.col(rank) + 1) % len(splits), F.lit(0)).cast("long"))
    return out.drop(*names), ranks


def write_curve(df: DataFrame, path: str, keys: Sequence[str], blooms: Mapping[str, int] | Sequence[str] = (), files: int | None = None, bits: int = 8) -> None:
    """Overwrite a Parquet table with files along the curve of the numeric ``keys``.

    ``blooms`` are columns with Bloom filters, optionally with their number of different values a file; those columns
    aren't written as dictionaries, as Parquet leaves the filter out where a dictionary says the same.  Files are ranges
    of the curve, then of the keys, so that a box of many equal rows is still shared out; ``files`` defaults to
    Spark's number of shuffle partitions.  Rows within a file are in order of the first key.
    """
    ranked, ranks = with_ranks(df, keys, bits)
    placed = ranked.withColumn(_PLACE, curve_place([F.col(r) for r in ranks], bits)).drop(*ranks)
    order = [_PLACE, *[F.col(f"`{k}`") for k in keys]]
    dealt = (placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys]).drop(_PLACE)
    writer = dealt.write.mode("overwrite").option("compression", "zstd")
    for c in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.enable.dictionary#{c}", "false")
        if isinstance(blooms, Mapping) and blooms[c]:
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{c}", str(blooms[c]))
    writer.parquet(path)
