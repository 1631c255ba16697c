"""The k nearest items of the same time, exactly: the pivot join of :mod:`plumbline.operators.nearest` over classes of items.

A query may meet the items whose year is within a window of its own, or whose season equals its own (null equals null),
except those of its own club in its own season.  Items of one year and season are a class with pivots and cells of its
own, so a query only looks into cells of the classes that it may meet, and there only into those that its bound leaves.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.nearest import _SLACK, Cells, _Best, _choose, _distances, _matrix, _rows

#: Places of a null, and of a value that no item has; queries of a task, and at a time.
_NULL, _NOWHERE, _TASK, _BATCH = -2, -1, 65_536, 1024


def _codes(values: pa.Array, known: pa.Array) -> np.ndarray:
    found = pc.fill_null(pc.index_in(values, value_set=known), _NOWHERE).to_numpy(zero_copy_only=False).astype(np.int64)
    found[values.is_null().to_numpy(zero_copy_only=False)] = _NULL
    return found


def _built(at: np.ndarray, classes: np.ndarray, weights: np.ndarray, most: int = 1024) -> tuple[Cells, np.ndarray, np.ndarray]:
    """Cells with their bounds, the class of each, and the cell of each item."""
    pivots, own, cell = [], [], np.zeros(len(at), np.int64)
    for c in np.unique(classes):
        mine = np.flatnonzero(classes == c)
        chosen = at[mine[_choose(at[mine], weights[0], min(most, int(np.ceil(np.sqrt(len(mine))))))]]
        for lo in range(0, len(mine), _BATCH):
            part = mine[lo : lo + _BATCH]
            cell[part] = len(own) + _distances(at[part], chosen, weights[0]).argmin(1)
        pivots.append(chosen)
        own += [c] * len(chosen)
    pivots, n = np.concatenate(pivots), len(own)
    low, high = np.zeros((len(weights), n)), np.zeros((len(weights), n))
    order = np.argsort(cell, kind="stable")
    starts = np.searchsorted(cell[order], np.arange(n + 1))
    for c in range(n):
        inside = at[order[starts[c] : starts[c + 1]]]
        for r in range(len(weights)) if len(inside) else ():
            far = _distances(inside, pivots[c : c + 1], weights[r])[:, 0]
            low[r, c], high[r, c] = far.min() * (1 - _SLACK), far.max() * (1 + _SLACK)
    return Cells(pivots, np.ones(n, bool), np.full(n, -1), weights, low, high, np.diff(starts)), np.array(own), cell


def nearest_in_time(queries: DataFrame, items: DataFrame, query: str, item: str, query_at: Sequence[str], item_at: Sequence[str], base: Sequence[float], roles: Mapping[str, Sequence[float]], query_role: str, query_time: tuple[Column, Column], item_time: tuple[Column, Column], query_club: Column, item_club: Column, window: int = 0, k: int = 3, distance: str = "distance", rank: str = "match_rank", room: int = 200_000, cells: int = 8192) -> DataFrame | None:
    """``query``, ``item``, ``distance`` and ``rank`` of the ``k`` items nearest to each query among those it may meet; ties go to
    the smaller ``item``.

    Times are (year, season); a null club is nobody's own.  None where items are over ``room``, classes need over ``cells`` cells or some
    coordinate is missing: then only the join in full serves.
    """
    names = list(roles)
    weights = np.array([list(base), *[list(roles[r]) for r in names]], dtype=np.float64)
    number: Column = F.lit(0)
    for i, r in enumerate(names, 1):
        number = F.when(F.col(query_role) == r, i).otherwise(number)

    def side(df: DataFrame, record: str, at: Sequence[str], role: Column, time: tuple[Column, Column], club: Column) -> DataFrame:
        return df.select(F.col(record).cast("long").alias("id"), role.cast("int").alias("role"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(at)], time[0].cast("int").alias("year"), time[1].cast("string").alias("season"), club.cast("string").alias("club"))

    width = len(base)
    q, i = side(queries, query, query_at, number, query_time, query_club), side(items, item, item_at, F.lit(0), item_time, item_club)
    missing = " or ".join(f"x{n} is null or isnan(x{n})" for n in range(width))
    if i.limit(room + 1).count() > room or not i.where(missing).isEmpty() or not q.where(missing).isEmpty():
        return None
    table = i.toArrow().combine_chunks()  # at most ``room``
    if not table.num_rows:
        return queries.sparkSession.createDataFrame([], f"`{query}` long, `{item}` long, `{distance}` double, `{rank}` int")
    at = np.column_stack([table[f"x{n}"].to_numpy() for n in range(width)])
    flat = lambda c: table[c].combine_chunks()
    seasons, clubs = (flat(c).unique().drop_null() for c in ("season", "club"))
    year = pc.fill_null(flat("year").cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    season, club = _codes(flat("season"), seasons), _codes(flat("club"), clubs)
    times, classes = np.unique(np.column_stack([year, season]), axis=0, return_inverse=True)
    built, of, cell = _built(at, classes.ravel(), weights)
    if len(of) > cells:
        return None
    ids = table["id"].to_numpy()
    order = np.lexsort((ids, cell))
    shared = queries.sparkSession.sparkContext.broadcast((built, of, times, seasons, clubs, ids[order], at[order], club[order], np.searchsorted(cell[order], np.arange(len(of) + 1))))
    unknown = np.iinfo(np.int64).min

    def search(x: np.ndarray, role: int, own_year: np.ndarray, own_season: np.ndarray, own_club: np.ndarray) -> _Best:
        built, of, times, _, _, ids, at, club, starts = shared.value
        known, theirs = own_year != unknown, times[:, 0] != unknown
        apart = np.abs(np.where(known, own_year, 0)[:, None] - np.where(theirs, times[:, 0], 0)[None, :])
        near = known[:, None] & theirs[None, :] & (apart <= window)
        same = own_season[:, None] == times[None, :, 1]
        able = (near | same)[:, of]
        least, _ = built.bounds(x, role, 1)
        least = np.where(able, least, np.inf)
        best = _Best(len(x), k, np.full(len(x), np.finfo(np.float64).max))  # excluded pairs are infinitely far
        first = least.argmin(1)
        for others in (False, True):
            # nearer cells first would need an order for each query: two rounds, the nearest cell and then the rest
            for c in np.flatnonzero(np.isfinite(least).any(0)).tolist():
                go = np.flatnonzero((least[:, c] <= best.most) & (first != c) if others else (first == c) & np.isfinite(least[:, c]))
                a, b = int(starts[c]), int(starts[c + 1])
                if len(go) and b > a:
                    far = _distances(x[go], at[a:b], built.weights[role])
                    own = same[go, of[c]][:, None] & (own_club[go][:, None] >= 0) & (own_club[go][:, None] == club[None, a:b])
                    far[own] = np.inf
                    best.add(go, far, ids[a:b])
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seasons, clubs = shared.value[3:5]
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH):
                part = batch.slice(lo, _BATCH)
                x, role = _matrix(part, 2, width), part.column(1).to_numpy()
                years = pc.fill_null(part.column(2 + width).cast(pa.int64()), unknown).to_numpy(zero_copy_only=False)
                own_season, own_club = _codes(part.column(3 + width), seasons), _codes(part.column(4 + width), clubs)
                for r in np.unique(role).tolist():
                    mine = role == r
                    yield _rows(part.column(0).to_numpy()[mine], search(x[mine], r, years[mine], own_season[mine], own_club[mine]))

    tasks = max(1, min(4096, -(-q.count() // _TASK)))
    found = q.repartition(tasks).mapInArrow(run, "q long, i long, d double")
    by = Window.partitionBy("q").orderBy("d", "i")
    return found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k).select(F.col("q").alias(query), F.col("i").alias(item), F.col("d").alias(distance), F.col("n").alias(rank))
