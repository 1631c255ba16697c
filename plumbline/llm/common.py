"""What the operators share: scratch tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.scratch import materialise, release

#: A word, as a regular expression for Spark and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers that one task writes at most, where a table's number of rows is known beforehand.
_ROWS_A_FILE = 500_000


def scratch(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage, survives lost executors.

    ``rows``, where known (an upper bound will do), keeps a small table from being written as many tiny files.
    """
    return materialise(df, None if rows is None else max(1, -(-rows // _ROWS_A_FILE)), tag)


def spare(columns: list[str], name: str) -> str:
    """A column name like ``name`` that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(columns: list[str]) -> list[Column]:
    """Columns by their whole names, which may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)``, which by itself can't take names with dots."""
    names = df.columns
    if not any("." in c or "`" in c for c in names):
        return df.mapInArrow(run, schema)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.rename_columns(names) for b in batches):
            yield out.rename_columns(plain.names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, plain).toDF(*schema.names)


_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives for ``key``, until the worker asks for another key: it is reused by all operators in turn, and
    tables of one that has ended aren't kept beside those of the next."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()  # tokenizers are in cycles
        _HELD[key] = make()
    return _HELD[key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``a``, ``b`` (long): rows ``node``, ``component`` (its smallest node).

    Each round hooks every node to its smallest neighbour, follows those pointers to their roots by doubling
    joins, and contracts the links to links between roots; at least half of the roots with links go per round.
    Every step is a join or an aggregation with map-side combine; lineage is cut by scratch tables.
    """
    links = scratch(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels, nodes = None, 0
    while n := links.count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"), F.lit(True).alias("moved")), "up", 2 * n)
        size = up.count()
        while True:
            top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hop = scratch(up.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up", size)
            release(up)
            up = hop
            if up.where("moved").isEmpty():
                break
        root = up.select("node", "up")
        if labels is None:
            nodes = size
            labels = root.select("node", F.col("up").alias("component"))
        else:
            labels = labels.join(root.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        nxt = (
            links.join(root.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a")
            .join(root.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        labels = scratch(labels, "labels", nodes)
        nxt = scratch(nxt, "links", n)
        release(links)
        links = nxt
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def typed(df: DataFrame, name: str, kind: str) -> Column:
    """The column ``name`` cast to ``kind``."""
    return df[name].cast(kind)
