"""Sharding by sampled splitters, in DataFrame functions only.

Records are put in a total order of keys (hash of the grouping value, then the record's id), so equal values stay
together.  Keys are sampled with chances in proportion to size, their weighted quantiles become splitters, records
are dealt into the ranges between splitters, and ranges that turn out overfull are cut again by a new sample
drawn within them.  Large groups of equal values get shards of their own choice, few as they are; cumulative sizes
over the ranges then cut the order of all others into what the shards have left, between groups.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import named, scratch

#: A uniform draw in [0, 1) that a key and a round decide, so that reruns agree.
_DRAW = 1 << 40
_LEAST = -(2**63)
#: Ranges at most, so that the driver's sample of keys has a bound.
_RANGES = 20_000


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below the key ``h``, ``d``, found in two steps over a sorted literal array."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    literal = lambda xs: F.from_json(F.lit(json.dumps([{"h": h, "d": d} for h, d in xs])), "array<struct<h:bigint,d:bigint>>")
    below = lambda xs: F.size(F.filter(xs, lambda s: s <= F.struct("h", "d")))
    coarse = below(literal(splitters[step - 1 :: step]))
    return (coarse * step + below(F.slice(literal(splitters), coarse * step + 1, step))).cast("int")


def _sample(df: DataFrame, rate: Column, seed: int) -> list[tuple[int, int, float]]:
    """Keys drawn with chance min(1, size * rate), each with the weight size * rate where that is above 1."""
    draw = F.pmod(F.xxhash64("h", "d", F.lit(seed)), F.lit(_DRAW)) / F.lit(float(_DRAW))
    rows = df.select("h", "d", (F.col("size") * rate).alias("w")).where(draw < F.col("w")).select("h", "d", F.greatest("w", F.lit(1.0)).alias("w")).collect()
    return sorted((r[0], r[1], r[2]) for r in rows)


def _quantiles(sample: list[tuple[int, int, float]], pieces: int) -> list[tuple[int, int]]:
    total, run, out = sum(w for *_, w in sample), 0.0, []
    for h, d, w in sample:
        if out and run >= total * (len(out) + 1) / pieces or not out and run >= total / pieces:
            out.append((h, d))
        run += w
    return out


def place_large(groups: list[tuple[int, int, int]], shards: int, fair: float, slack: float) -> tuple[list[tuple[int, float, int]], list[float]]:
    """Shards for the large ``groups`` (key, size, rows), largest first, and what each shard then holds.

    A group goes whole to the emptiest shard if that stays within ``fair`` times 1 + ``slack``, or if it is one record;
    else it fills up shards, emptiest first.  Pieces are (key, end within the group's running total, shard).
    """
    load, pieces = [0.0] * shards, []
    for key, size, rows in sorted(groups, key=lambda g: (-g[1], g[0])):
        at = 0.0
        while at < size:
            shard = min(range(shards), key=lambda i: (load[i], i))
            room = fair - load[shard]
            whole = rows == 1 or size - at <= room + slack * fair or room <= slack * fair
            part = size - at if whole else room
            at += part
            load[shard] += part
            pieces.append((key, float("inf") if whole else at, shard))
    return pieces, load


def shard(df: DataFrame, size: str, group: str, record: str, shards: int, ranges_per_shard: int = 4, keys_per_range: int = 24, rows_per_range: int = 1_000_000, overfull: float = 2.0, rounds: int = 4, slack: float = 0.02) -> DataFrame:
    """Give every record a ``shard`` (0 to shards-1) and a ``slot`` (gapless from 0 in its shard).

    ``size`` is a positive long column, ``group`` a long key, evenly spread such as a hash, whose equal values should
    stay together, ``record`` a long that orders records of a group (null in either: as the smallest).  The law is
    *bytes*: shards' sizes are near equal.  A group goes whole to one shard; only one that doesn't fit into any shard
    by more than ``slack`` of a shard's fair size is cut, between records.  Shards differ from the mean by ``slack``
    and half a group of that size, or by the size of a single record that is larger.  Ties and repeated rows: records
    with equal keys are interchangeable and each gets a slot of its own.  An empty table gives no rows.  Texts aren't
    looked at, so their length doesn't matter.  Columns ``shard`` and ``slot`` replace input columns of these names;
    any other names pass through.

    The driver sees a sample of at most about ranges * keys_per_range keys (ranges = max(shards * ranges_per_shard,
    rows / rows_per_range), 20,000 at most) and the groups of more than ``slack`` of a fair size, at most shards / slack.
    A range is at most ``overfull`` times its fair size after at most ``rounds`` rounds of cutting, unless single
    records or equal keys are larger than that.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_LEAST))
    keyed = scratch(df.select(F.struct(*named(kept)).alias("row"), key(group).alias("h"), key(record).alias("d"), F.col(size).cast("long").alias("size")), "shard")
    n, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    fair = max(1.0, total / shards)
    groups = keyed.groupBy("h").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("s") > slack * fair).collect()
    pieces, load = place_large([tuple(r) for r in groups], shards, fair, slack)
    cut = {h for h, end, _ in pieces if end != float("inf")}
    n_ranges = min(_RANGES, max(shards * ranges_per_shard, -(-n // rows_per_range)))
    usual = max(1.0, total / n_ranges)
    whole = lambda found: sorted({(h, d if h in cut else _LEAST) for h, d in found})  # noqa: E731  between groups, but for those that are cut
    splitters = whole(_quantiles(_sample(keyed, F.lit(n_ranges * keys_per_range / max(1, total)), 0), n_ranges))
    for seed in range(1, rounds):
        dealt = keyed.withColumn("range", _range_of(splitters))
        sums = dealt.groupBy("range").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        large = {r["range"]: r["s"] for r in sums.where((F.col("s") > overfull * usual) & (F.col("n") > 1)).collect()}
        if not large:
            break
        found: dict[int, list] = {}
        for x in _sample(dealt.where(F.col("range").isin(list(large))), F.lit(keys_per_range / usual), seed):
            lo, hi = 0, len(splitters)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if splitters[mid] <= x[:2] else (lo, mid)
            found.setdefault(lo, []).append(x)
        more = set(whole(s for r, xs in found.items() for s in _quantiles(xs, 2 + int(large[r] / usual)))) - set(splitters)
        if not more:
            break
        splitters = sorted([*splitters, *more])
    # a large group's pieces, numbered from 1; number 0 of a shard is its part of all other groups
    spark = df.sparkSession
    plan: dict[int, list] = {}
    for i, (h, end, s) in enumerate(pieces, 1):
        plan.setdefault(h, []).append((end, s, i))
    plans = spark.createDataFrame(list(plan.items()), "h long, pieces array<struct<end:double,shard:int,unit:int>>")
    dealt = keyed.withColumn("range", _range_of(splitters)).join(plans, "h", "left")
    big = F.col("pieces").isNotNull()
    # tables of a row a range, and of a row a range and large group
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    small = lambda what: F.coalesce(F.sum(F.when(~big, what)), F.lit(0))
    offsets = dealt.groupBy("range").agg(small(F.col("size")).alias("s"), small(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    before = Window.partitionBy("h").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.where(big).groupBy("h", "range").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).select("h", "range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("g0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("c0"))
    own = Window.partitionBy("range").orderBy("h", "d")
    peers = Window.partitionBy("range").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    group_ = Window.partitionBy("range", "h")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumns({
        "through": F.sum(F.when(big, 0).otherwise(F.col("size"))).over(peers),
        "rank": F.sum(F.when(big, 0).otherwise(1)).over(upto(own)),
        "together": F.sum("size").over(group_),
        "run": F.sum("size").over(upto(group_.orderBy("d"))),
        "nth": F.row_number().over(group_.orderBy("d")),
    }).join(offsets, "range").join(parts, ["h", "range"], "left")
    room = [max(0.0, fair - x) for x in load]
    scale = (total - sum(r["s"] for r in groups)) / max(1.0, sum(room))
    ends = [sum(room[: i + 1]) * scale for i in range(shards)]
    middle = F.col("s0") + F.col("through") - F.col("together") / 2.0
    rest = F.size(F.filter(F.array(*map(F.lit, ends[:-1])).cast("array<double>"), lambda e: e <= middle)).cast("int")
    piece = F.element_at(F.filter("pieces", lambda p: p["end"] > F.col("g0") + F.col("run") - F.col("size") / 2.0), 1)
    # number: the place in the order of all other groups, or in the large group
    unit = F.when(big, piece).otherwise(F.struct(F.lit(0.0).alias("end"), rest.alias("shard"), F.lit(0).alias("unit")))
    number = F.when(big, F.col("c0") + F.col("nth")).otherwise(F.col("n0") + F.col("rank"))
    placed = scratch(placed.select("row", unit.alias("u"), number.alias("number")).select("row", "u.shard", "u.unit", "number"), "shard")
    ahead = Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "unit").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).select("shard", "unit", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("base"))
    return placed.join(starts, ["shard", "unit"]).select("row.*", "shard", (F.col("number") + F.col("base")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a sharded table as Parquet folders ``shard=N``, records in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
