"""Statistics by group given back to rows: robust and plain z-scores, shrinkage, ranks, calibrated 0-10 scores.

A statistic is one aggregation with map-side combine, joined back to the rows null-safely (a null key is a group of
its own unless stated).  Statistics are written before they are joined, so a chain of them keeps a short plan and
Spark knows their size when it chooses whether to broadcast them; those of all rows are one row, put in as literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.exprs import Expr, clip, col, nonzero, soft_clip, tanh_score
from plumbline.sources.scratch import materialise

MAD_TO_SIGMA = 1.4826


#: Values of a group up to which one task takes its exact quantiles; beyond, ranges of values share the work.
LARGE = 4_000_000


def is_large(df: DataFrame, keys: Sequence[str] = ()) -> bool:
    """Whether some group (or, without keys, the table) has more than ``LARGE`` rows; it only decides how quantiles that
    are exact either way are computed."""
    if df.count() <= LARGE:
        return False
    return not keys or (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > LARGE


def range_quantiles(df: DataFrame, cells: Mapping[str, tuple[Column, float]], keys: Sequence[str] = (), slack: float = 0.002) -> DataFrame:
    """``keys`` (as ``_key_0``, ...) and, for each name -> (value, p), its exact quantile with linear interpolation.

    No group gathers in a task: approximate quantiles (with a rank error of a tenth of ``slack``) give two bounds that
    the wanted ranks surely lie between; values below are counted, and only the distinct values between them are put
    in order, with their counts.
    """
    names = [f"_key_{i}" for i in range(len(keys))]
    cell = F.explode(F.array(*[F.struct(F.lit(o).alias("_o"), F.lit(float(p)).alias("_p"), x.cast("double").alias("_x")) for o, (x, p) in cells.items()])).alias("c")
    long = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], cell).select(*names, "c.*").where("_x is not null")
    at = sorted({p for _, p in cells.values()})
    marks = [m for p in at for m in (max(0.0, p - slack), min(1.0, p + slack))]
    by = [*names, "_o"]
    found = long.groupBy(*by).agg(F.percentile_approx("_x", marks, int(10 / slack)).alias("_m"), F.count(F.lit(1)).alias("_n"))
    place = sum((F.when(F.col("_p") == p, 2 * i).otherwise(0) for i, p in enumerate(at)), F.lit(0)).cast("int")
    bounds = materialise(found.select(*[F.col(c).alias(f"_b{c}") for c in by], "_m", "_n"))
    meet = _both([long[c].eqNullSafe(bounds[f"_b{c}"]) for c in by])
    placed = long.join(bounds, meet).select(*by, "_p", "_x", "_n", F.get("_m", place).alias("_lo"), F.get("_m", place + 1).alias("_hi"))
    low, high = F.col("_x") < F.col("_lo"), F.col("_x") > F.col("_hi")
    beside = [F.count(F.when(low, 1)).alias("_below"), F.max(F.when(low, F.col("_x"))).alias("_prev"), F.min(F.when(high, F.col("_x"))).alias("_next")]
    below = materialise(placed.groupBy(*by).agg(*beside).select(*[F.col(c).alias(f"_b{c}") for c in by], "_below", "_prev", "_next"))
    inside = placed.where(F.col("_x").between(F.col("_lo"), F.col("_hi"))).groupBy(*by, "_p", "_n", "_x").agg(F.count(F.lit(1)).alias("_c"))
    inside = inside.join(below, _both([inside[c].eqNullSafe(below[f"_b{c}"]) for c in by])).drop(*[f"_b{c}" for c in by])
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.col("_p") * (F.col("_n") - 1)
    # of few values, a wanted rank may be that of the neighbour of the bounds
    first = lambda r: F.coalesce(F.min(F.when(r < F.col("_below"), F.col("_prev")).when(F.col("_upto") > r, F.col("_x"))), F.max("_next"))
    two = inside.withColumns({"_upto": upto, "_r": rank}).groupBy(*by).agg(first(F.floor("_r")).alias("_v"), first(F.ceil("_r")).alias("_w"), F.max(F.col("_r") - F.floor("_r")).alias("_f"))
    value = two.select(*names, "_o", (F.col("_v") + (F.col("_w") - F.col("_v")) * F.col("_f")).alias("_q"))
    return value.groupBy(*names).agg(*[F.max(F.when(F.col("_o") == o, F.col("_q"))).alias(o) for o in cells])


def with_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column], null_group: bool = True, quantiles: Mapping[str, tuple[Column, float]] | None = None, large: bool | None = None) -> DataFrame:
    """Add ``stats``, aggregated by ``keys``, to every row; without keys they are taken over all rows.

    ``quantiles`` (name -> value, p) are added likewise; ``large`` says whether a group is too large to take them in one
    task (None: find out).  With ``null_group`` false, rows with a null key get nulls.
    """
    cells = dict(quantiles or {})
    far = bool(cells) and (is_large(df, keys) if large is None else large)
    aggs = [c.alias(n) for n, c in stats.items()] + ([] if far else [quantile(x, p).alias(n) for n, (x, p) in cells.items()])
    added = [*stats, *cells]
    if not keys:
        row = (df.agg(*aggs).first().asDict() if aggs else {}) | (range_quantiles(df, cells).first().asDict() if far else {})
        return df.withColumns({n: F.lit(row[n]) if row[n] is not None else F.lit(None).cast("double") for n in added})
    names = [f"_key_{i}" for i in range(len(keys))]
    same = lambda left, right, of: _both([left[a].eqNullSafe(right[b]) for a, b in of])
    by = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(*(aggs or [F.lit(1).alias("_one")]))
    if far:
        more = range_quantiles(df, cells, keys).withColumnsRenamed({n: f"_q{n}" for n in names})
        by = by.join(more, same(by, more, [(n, f"_q{n}") for n in names]), "left").drop(*[f"_q{n}" for n in names])
    by = materialise(by.select(*names, *added))
    cond = None
    for k, n in zip(keys, names):
        one = df[k].eqNullSafe(by[n]) if null_group else df[k] == by[n]
        cond = one if cond is None else cond & one
    return df.join(by, cond, "left").drop(*names)


def quantile(x: Expr, p: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(col(x), F.lit(p))


def median(x: Expr) -> Column:
    return quantile(x, 0.5)


def medians(df: DataFrame, columns: Sequence[str], large: bool | None = None) -> dict[str, float | None]:
    """The exact median of each column over all rows."""
    if is_large(df) if large is None else large:
        return range_quantiles(df, {c: (F.col(c), 0.5) for c in columns}).first().asDict()
    return df.agg(*[median(c).alias(c) for c in columns]).first().asDict()


def _scale(mad: Expr, std: Expr) -> Column:
    return F.coalesce(nonzero(MAD_TO_SIGMA * col(mad)), nonzero(std), F.lit(1.0))


def robust_z(df: DataFrame, values: Mapping[str, str], keys: Sequence[str] = (), large: bool | None = None) -> DataFrame:
    """Add, for each output name -> column, (x - median) / scale by group.

    Scale is 1.4826 times the median absolute deviation, else the standard deviation (of the sample within groups, of
    the population over all rows), else 1.
    """
    std = F.stddev_samp if keys else F.stddev_pop
    large = is_large(df, keys) if large is None else large
    df = with_stats(df, keys, {f"_std_{o}": std(x) for o, x in values.items()}, quantiles={f"_med_{o}": (F.col(x), 0.5) for o, x in values.items()}, large=large)
    df = with_stats(df, keys, {}, quantiles={f"_mad_{o}": (F.abs(F.col(x) - F.col(f"_med_{o}")), 0.5) for o, x in values.items()}, large=large)
    df = df.withColumns({o: (F.col(x) - F.col(f"_med_{o}")) / _scale(f"_mad_{o}", f"_std_{o}") for o, x in values.items()})
    return df.drop(*[f"_{s}_{o}" for s in ("med", "std", "mad") for o in values])


def calibrated_scores(df: DataFrame, values: Mapping[str, str], keys: Sequence[str] = (), soft: float | None = None, percentile: float = 90.0, shrink: float = 50.0, center: float = 5.0, span: float = 4.0, high: float = 10.0, fixed: tuple[float, float] | None = None) -> DataFrame:
    """Add, for each output name -> column, a score of 0 to ``high`` with ``center`` at the median.

    The robust z within the group and over all rows are blended by n / (n + shrink) for the group's n values, and so
    are the percentiles of their sizes that calibrate the tanh.  ``soft`` clips both z softly before that; ``fixed``
    gives center and scale of all rows in place of median and deviation.  A null value has a null score.
    """
    zg, zo = {f"_zg_{o}": x for o, x in values.items()}, {f"_zo_{o}": x for o, x in values.items()}
    squash = (lambda z: soft_clip(z, soft)) if soft else col
    whole = is_large(df)
    large = whole and bool(keys) and is_large(df, keys)
    if fixed:
        df = df.withColumns({f"_zo_{o}": (F.col(x) - fixed[0]) / (fixed[1] or 1.0) for o, x in values.items()})
    else:
        df = robust_z(df, zo, large=whole)
    grouped = bool(keys) and not fixed
    if grouped:
        df = robust_z(df, zg, keys, large)
    df = df.withColumns({z: squash(z) for z in [*zo, *(zg if grouped else ())]})
    size = lambda z: (F.abs(F.col(z)), percentile / 100.0)
    df = with_stats(df, (), {}, quantiles={f"_qo_{o}": size(f"_zo_{o}") for o in values}, large=whole)
    if grouped:
        df = with_stats(df, keys, {f"_n_{o}": F.count(x) for o, x in values.items()}, quantiles={f"_qg_{o}": size(f"_zg_{o}") for o in values}, large=large)
    unit = lambda q: F.coalesce(nonzero(q), F.lit(1.0))
    out = {}
    for o in values:
        if grouped:
            w = F.col(f"_n_{o}") / (F.col(f"_n_{o}") + shrink)
            z = w * F.col(f"_zg_{o}") + (1.0 - w) * F.col(f"_zo_{o}")
            scale = w * unit(f"_qg_{o}") + (1.0 - w) * unit(f"_qo_{o}")
        else:
            z, scale = F.col(f"_zo_{o}"), unit(f"_qo_{o}")
        out[o] = tanh_score(z / scale, center, span, high)
    return df.withColumns(out).drop(*[f"_{s}_{o}" for s in ("zg", "zo", "qo", "qg", "n") for o in values])


def z_scores(df: DataFrame, values: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Add (x - mean) / population deviation; 0 where the deviation is 0 or the key is null, null where x is.

    Without keys a deviation of 0 gives 0 for every row.
    """
    df = with_stats(df, keys, {f"_avg_{o}": F.avg(x) for o, x in values.items()} | {f"_std_{o}": F.stddev_pop(x) for o, x in values.items()}, null_group=False)
    z = lambda o, x: (F.col(x) - F.col(f"_avg_{o}")) / nonzero(f"_std_{o}")
    if keys:
        out = {o: F.when(F.col(x).isNotNull(), F.coalesce(z(o, x), F.lit(0.0))) for o, x in values.items()}
    else:
        out = {o: F.when(F.coalesce(F.col(f"_std_{o}"), F.lit(0.0)) == 0, 0.0).otherwise(z(o, x)) for o, x in values.items()}
    return df.withColumns(out).drop(*[f"_{s}_{o}" for s in ("avg", "std") for o in values])


def train_only_z(df: DataFrame, value: str, out: str, train: Expr, keys: Sequence[str] = ()) -> DataFrame:
    """z-score by statistics of the rows where ``train`` holds, given to all rows.

    Within groups the deviation is the sample's; a group without one, or with 0, takes that of all training rows.
    """
    x = F.when(col(train), F.col(value))
    df = with_stats(df, (), {"_avg_all": F.avg(x), "_std_all": F.stddev_pop(x)})
    avg, std = F.col("_avg_all"), F.coalesce(nonzero("_std_all"), F.lit(1.0))
    if keys:
        df = with_stats(df, keys, {"_avg": F.avg(x), "_std": F.stddev_samp(x)})
        avg, std = F.coalesce("_avg", avg), F.coalesce(nonzero("_std"), std)
    return df.withColumn(out, (F.col(value) - avg) / std).drop("_avg_all", "_std_all", "_avg", "_std")


def shrink_by_volume(df: DataFrame, values: Mapping[str, str], volume: str, keys: Sequence[str] = (), center: str = "median") -> DataFrame:
    """Add w * x + (1 - w) * group mean with w = volume / (volume + k).

    k is the group's median (or mean) volume; where that is 0 or null, the median of the groups' k over rows, else 1.
    Rows with a null key get nulls.  A volume below 0 counts as 0.
    """
    df = df.withColumn("_m", clip(volume, low=0.0))
    middle, k = ({"_k": (F.col("_m"), 0.5)}, {}) if center == "median" else ({}, {"_k": F.avg("_m")})
    df = with_stats(df, keys, {f"_avg_{o}": F.avg(x) for o, x in values.items()} | k, null_group=False, quantiles=middle)
    df = df.withColumn("_k", nonzero("_k"))
    if keys:
        df = with_stats(df, (), {}, quantiles={"_k_all": (F.col("_k"), 0.5)}, large=False)  # a value a group
        df = df.withColumn("_k", F.coalesce("_k", "_k_all"))
    w = F.col("_m") / (F.col("_m") + F.coalesce("_k", F.lit(1.0)))
    df = df.withColumns({o: w * F.col(x) + (1.0 - w) * F.col(f"_avg_{o}") for o, x in values.items()})
    return df.drop("_m", "_k", "_k_all", *[f"_avg_{o}" for o in values])


def percentile_ranks(df: DataFrame, value: str, out: str, keys: Sequence[str] = (), scale: float = 1.0, least: int = 1, split: bool | None = None) -> DataFrame:
    """Average rank over the number of values, times ``scale``; null where x is, or the group has under ``least`` values.

    Within keys the ranks are windows: one exchange serves all columns ranked by the same keys.  Over all rows, or with
    ``split`` (None: where some group is too large for a task), ranks come from the counts of distinct values, summed
    along their order and joined back by value.
    """
    if keys and not (is_large(df, keys) if split is None else split):
        w = Window.partitionBy(*keys)
        n = F.count(value).over(w)
        # the mean of the first and the last place that equal values share
        place = (F.rank().over(w.orderBy(F.asc_nulls_last(value))) + n + 1 - F.rank().over(w.orderBy(F.desc_nulls_last(value)))) / 2.0
        return df.withColumn(out, F.when(F.col(value).isNotNull() & (n >= least), place / n * scale))
    return _join_ranks(df, _ranks(df, value, keys, scale, least), value, out, keys)


def _ranks(df: DataFrame, value: str, keys: Sequence[str], scale: float, least: int) -> DataFrame:
    """``_key_0``, ..., ``_x`` and ``_pct`` of each distinct value."""
    names = [f"_key_{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(F.lit("").alias("_f"), *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).alias("_x"))
    return materialise(_placed(rows, ["_f", *names], scale, least).drop("_f"))


def _join_ranks(df: DataFrame, ranks: DataFrame, value: str, out: str, keys: Sequence[str]) -> DataFrame:
    names = [f"_key_{i}" for i in range(len(keys))]
    cond = df[value] == ranks["_x"]
    for k, n in zip(keys, names):
        cond = cond & df[k].eqNullSafe(ranks[n])
    return df.join(ranks.withColumnRenamed("_pct", out), cond, "left").drop("_x", *names)


def _placed(rows: DataFrame, keys: Sequence[str], scale: float, least: int | Column, slices: int = 256) -> DataFrame:
    """``keys``, ``_x`` and ``_pct`` from the counts of distinct values, summed along their order.

    The order of each key's values is cut into slices at approximate quantiles; these only place the cuts, sums are
    exact whatever they are.
    """
    counts = rows.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    same = lambda a, b: _both([a[k].eqNullSafe(b[f"_b{k}"]) for k in keys])
    renamed = lambda t: t.select(*[F.col(k).alias(f"_b{k}") for k in keys], *[c for c in t.columns if c not in keys])
    cuts = renamed(counts.groupBy(*keys).agg(F.percentile_approx("_x", [i / slices for i in range(1, slices)], 10_000).alias("_cuts")))
    cut = counts.join(cuts, same(counts, cuts)).withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).select(*keys, "_x", "_c", "_slice")
    w = Window.partitionBy(*keys)
    sums = cut.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_s"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_s").over(w)}).drop("_s")  # a row a slice
    sums = renamed(sums.withColumnRenamed("_slice", "_bslice"))
    own = cut.withColumn("_own", F.sum("_c").over(Window.partitionBy(*keys, "_slice").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = own.join(sums, same(own, sums) & (own["_slice"] == sums["_bslice"]))
    rank = F.col("_before") + F.col("_own") - (F.col("_c") - 1) / 2.0
    return placed.select(*keys, "_x", F.when(F.col("_all") >= least, rank / F.col("_all") * scale).alias("_pct"))


def _both(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def hierarchical_percentiles(df: DataFrame, values: Mapping[str, str], levels: Sequence[Sequence[str]], least: int = 8, empty: float = 50.0, split: bool | None = None) -> DataFrame:
    """For each output name -> column the percentile rank (0-100) in the first of ``levels`` (key lists) with ``least``
    values, else over all rows with two values, else ``empty``.

    The table goes into long form once: a row for each level, column and value.  One exchange and one sort rank all of
    them, and one aggregation by row picks the first level and makes columns again, however many columns there are.  With
    ``split`` (None: beyond ``LARGE`` rows) ranks come from counts of distinct values, see :func:`percentile_ranks`.
    """
    names = sorted({k for keys in levels for k in keys})
    rows = materialise(df.select("*", F.monotonically_increasing_id().alias("_row")), tag="ranked")  # written, so that the numbers stay
    tables = [*map(set, levels), set()]
    cells = [F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("x")) for i, c in enumerate(values.values())]
    groups = [F.struct(F.lit(i).alias("l"), *[(F.col(k) if k in keys else F.lit(None).cast(df.schema[k].dataType)).alias(f"k{n}") for n, k in enumerate(names)]) for i, keys in enumerate(tables)]
    long = rows.select("_row", F.explode(F.filter(F.array(*cells), lambda c: c["x"].isNotNull())).alias("c"), F.array(*groups).alias("g"))
    long = long.select("_row", F.col("c.f").alias("_f"), F.col("c.x").alias("_x"), F.explode("g").alias("g")).select("_row", "_f", "_x", F.col("g.l").alias("_l"), *[F.col(f"g.k{n}").alias(f"_g{n}") for n in range(len(names))])
    keys = ["_l", "_f", *[f"_g{n}" for n in range(len(names))]]
    enough = F.when(F.col("_l") == len(levels), 2).otherwise(least)
    if rows.count() > LARGE if split is None else split:
        ranks = materialise(_placed(long, keys, 100.0, enough), tag="ranks").withColumnsRenamed({c: f"_r{c}" for c in [*keys, "_x"]})
        ranked = long.join(ranks, _both([long[c].eqNullSafe(ranks[f"_r{c}"]) for c in [*keys, "_x"]]))
    else:
        own = Window.partitionBy(*keys)
        upto = own.orderBy("_x")
        place = F.rank().over(upto) + (F.count(F.lit(1)).over(upto.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0
        n = F.count(F.lit(1)).over(own)
        ranked = long.withColumn("_pct", F.when(n >= enough, place / n * 100.0))
    first = lambda i: F.min(F.when((F.col("_f") == i) & F.col("_pct").isNotNull(), F.struct("_l", "_pct")))["_pct"]
    wide = ranked.groupBy("_row").agg(*[first(i).alias(f"_p{i}") for i in range(len(values))])
    out = rows.join(materialise(wide, tag="ranks"), "_row", "left")
    return out.select(*[c for c in df.columns if c not in values], *[F.coalesce(f"_p{i}", F.lit(float(empty))).alias(o) for i, o in enumerate(values)])


def hierarchical_percentile(df: DataFrame, value: str, out: str, levels: Sequence[Sequence[str]], least: int = 8, empty: float = 50.0) -> DataFrame:
    """:func:`hierarchical_percentiles` of one column."""
    return hierarchical_percentiles(df, {out: value}, levels, least, empty)
