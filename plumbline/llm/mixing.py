"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions.

Each source's documents are shuffled by a hash and queue up, the whole queue again for each further copy.  A
document's virtual finish time is the words its source has queued up to its end over the source's target.  Documents
of all sources are range-sorted by it and the sorted mix is cut at the total budget, so at the cut every source has
had its target but for the document at its edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, named, scratch


def cyclic_weights(sources: list[str | None], weights: tuple[float, ...] = (5, 2, 1)) -> list[float]:
    """Weights repeating over the sources in code-point order, null last."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    rank = {s: i for i, s in enumerate(order)}
    return [float(weights[rank[s] % len(weights)]) for s in sources]


def fill_targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = 3.0) -> list[float]:
    """Targets in proportion to weights that sum to ``share`` of all sizes; none above ``most`` times its size.

    What a capped source can't take is shared again among the others by weight until none is above its cap.
    """
    targets, left, open_ = [0.0] * len(sizes), sum(sizes) * share, set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = most * sizes[i]
        left -= sum(targets[i] for i in over)
        open_ -= over
    return targets


def _counted(docs: DataFrame, seed: str, weights: Callable[[list], list[float]], most: int, share: float, text: str, source: str, record: str, rows_per_bucket: int) -> DataFrame:
    """Rows ``row`` (all of a document), ``size``, ``source_size``, ``target``, ``copies``."""
    spark = docs.sparkSession
    size = F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0))
    hashed = F.md5(F.concat(F.coalesce(F.col(record).cast("string"), F.lit("null")), F.lit(seed)))
    sized = docs.select(F.struct(*named(docs.columns)).alias("row"), F.col(source).cast("string").alias("s"), hashed.alias("h"), F.when(F.col(text).isNull(), 0).otherwise(size).cast("long").alias("size"))
    # the queue: narrow rows, dealt by source and the leading digits of the shuffle hash
    narrow = scratch(sized.select("s", "h", "size"), "queue").groupBy("s", "h").agg(F.sum("size").alias("size"))
    queue = scratch(narrow, "queue")
    totals = queue.groupBy("s").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sources, sizes = [r["s"] for r in totals], [r["size"] for r in totals]
    targets = fill_targets(sizes, weights(sources), share, most)
    digits, largest = 2, max((r["n"] for r in totals), default=0)
    while digits < 8 and largest / 16**digits > rows_per_bucket / 8:
        digits += 1
    plan = spark.createDataFrame([(s, int(z), float(t)) for s, z, t in zip(sources, sizes, targets)], "ps string, source_size long, target double")
    # running totals by source: sums of buckets, which a window over (source, leading digit) and sums of those place,
    # then within each bucket
    bucket = queue.withColumn("b", F.substring("h", 1, digits))
    sums = bucket.groupBy("s", "b").agg(F.sum("size").alias("z")).withColumn("top", F.substring("b", 1, digits // 2))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    tops = sums.groupBy("s", "top").agg(F.sum("z").alias("tz")).select(F.col("s").alias("ts"), F.col("top").alias("tt"), F.coalesce(F.sum("tz").over(earlier("s").orderBy("top")), F.lit(0)).alias("t0"))
    offsets = sums.withColumn("z0", F.coalesce(F.sum("z").over(earlier("s", "top").orderBy("b")), F.lit(0))).join(tops, F.col("s").eqNullSafe(F.col("ts")) & (F.col("top") == F.col("tt"))).select(F.col("s").alias("os"), F.col("b").alias("ob"), (F.col("z0") + F.col("t0")).alias("z0"))
    run = F.sum("size").over(Window.partitionBy("s", "b").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = bucket.withColumn("z", run).join(offsets, F.col("s").eqNullSafe(F.col("os")) & (F.col("b") == F.col("ob"))).select("s", "h", "size", (F.col("z") + F.col("z0")).alias("cum"))
    placed = scratch(placed.join(plan, F.col("s").eqNullSafe(F.col("ps"))).drop("ps"), "queue")
    finish = lambda e: (e * F.col("source_size") + F.col("cum")) / F.col("target")
    items = placed.where("size > 0 and target > 0").select("s", "h", "size", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("e"), "cum", "source_size", "target").select("s", "h", "size", "e", finish(F.col("e")).alias("v"))
    # global range sort: equal ranges of virtual time hold about equal numbers of words; only the range that holds the cut is sorted
    budget = sum(sizes) * share
    ranges = max(64, int(sum(r["n"] for r in totals) * most / rows_per_bucket))
    ranged = items.withColumn("r", F.floor(F.col("v") * ranges))
    sums = ranged.groupBy("r").agg(F.sum("size").alias("z"))
    upto = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a range
    cut = sums.withColumn("upto", F.sum("z").over(upto)).where(F.col("upto") > budget).orderBy("r").limit(1).collect()
    if cut:
        r, start = cut[0]["r"], cut[0]["upto"] - cut[0]["z"]
        order = Window.partitionBy("r").orderBy("v", F.col("s").asc_nulls_last(), "h", "e")
        last = ranged.where(F.col("r") == r).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + start).where(F.col("upto") > budget).orderBy("upto").limit(1).collect()[0]
        key = lambda e: F.struct(finish(e).alias("v"), F.col("s").isNull().alias("sn"), F.coalesce("s", F.lit("")).alias("s"), F.col("h").alias("h"))
        end = F.struct(F.lit(last["v"]).alias("v"), F.lit(last["s"] is None).alias("sn"), F.lit(last["s"] or "").alias("s"), F.lit(last["h"]).alias("h"))
        taken = lambda e: (key(F.lit(e)) < end).cast("int")
    else:
        taken = lambda e: F.lit(1)
    copies = sum((taken(e) for e in range(1, most)), taken(0))
    result = scratch(placed.select(F.col("s").alias("rs"), F.col("h").alias("rh"), "source_size", "target", F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(0).alias("copies")), "queue")
    return sized.join(result, F.col("h").eqNullSafe(F.col("rh")) & F.col("s").eqNullSafe(F.col("rs"))).select("row", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: str = "mix", weights: Callable[[list], list[float]] = cyclic_weights, most: int = 3, share: float = 1.0, text: str = "text", source: str = "source", record: str = "doc_id", rows_per_bucket: int = 500_000) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` = copies * size to ``docs``.

    Size is the number of words (null text: 0), however long the text.  A document is taken 0 to ``most`` times.  The
    shuffle is the md5 of the id and ``seed`` (a null id's is that of the word null); equal ids (repeated rows) of a
    source are summed and share one place in the queue, so they are taken together.  A document of size 0 has taken 0
    and is copied 0 times.  Columns of the five names are replaced, those of any other name pass through.  An empty
    table gives no rows.  The driver sees one row a source (a label set: some hundred bytes each) and the one cut row;
    a source's queue is cut into at least 256 buckets, of about ``rows_per_bucket`` / 8 rows of the largest source.
    """
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies", "taken")]
    out = _counted(docs.select(*named(kept)), seed, weights, most, share, text, source, record, rows_per_bucket)
    return out.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix", weights: Callable[[list], list[float]] = cyclic_weights, most: int = 3, share: float = 1.0, text: str = "text", source: str = "source", record: str = "doc_id", rows_per_bucket: int = 500_000) -> DataFrame:
    """The mix itself: every document as often as :func:`mix` takes it, with all columns of ``docs`` as they are."""
    out = _counted(docs, seed, weights, most, share, text, source, record, rows_per_bucket)
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
