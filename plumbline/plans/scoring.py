"""From statistics tables to calibrated scores: components, targets by position, ratings and the scored table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.exprs import linear_score, position_bucket, rating
from plumbline.operators.linalg import component_scores
from plumbline.operators.stats import calibrated_scores, percentile_ranks, shrink_by_volume, z_scores
from plumbline.sources.io import drop_empty, read_table, unique_names

#: Columns of each component and their weights (negative: less is better).
COMPONENTS: dict[str, list[tuple[str, float]]] = {
    "attack_score": [("goals_per_90_overall", 1.0), ("goals_involved_per_90_overall", 1.0), ("goals_assists_per_90", 1.0)],
    "assist_score": [("assists_per_90_overall", 1.0)],
    "conceded_score": [("conceded_per_90_overall", -1.0)],
    "tackle_score": [("tackles_per_90_overall", 1.0), ("tackles_successful_per_90_overall", 1.0)],
    "foul_card_score": [("cards_per_90_derived", -1.0), ("cards_per_90_overall", -1.0), ("red_cards_per_90_derived", -1.0), ("yellow_cards_per_90_derived", -1.0)],
    "goalkeeper_score": [("saves_per_90_overall", 1.0), ("save_percentage_overall", 1.0), ("clean_sheets_per_90_derived", 1.0)],
    "appearance_score": [("minutes_played_overall", 1.0), ("appearances_overall", 1.0), ("nineties", 1.0), ("minutes_per_appearance", 1.0), ("age", -0.2)],
}
_FIELD = ["attack_score", "assist_score", "conceded_score", "foul_card_score", "appearance_score"]
#: Components that count for each position bucket.
ALLOWED: dict[str, list[str]] = {"GK": ["goalkeeper_score", "conceded_score", "foul_card_score", "appearance_score"], "DEF": _FIELD, "MID": _FIELD, "FWD": _FIELD, "OTHER": _FIELD}
#: Weights of the displayed rating by bucket.
RATING_WEIGHTS: dict[str, dict[str, float]] = {
    "FWD": {"attack_score": 0.28, "assist_score": 0.22, "passing_score": 0.10, "defense_score": 0.08, "foul_card_score": 0.06, "aerial_score": 0.11, "conceded_score": 0.15},
    "MID": {"passing_score": 0.24, "assist_score": 0.20, "attack_score": 0.16, "defense_score": 0.16, "foul_card_score": 0.06, "aerial_score": 0.08, "conceded_score": 0.10},
    "DEF": {"defense_score": 0.26, "aerial_score": 0.14, "conceded_score": 0.12, "ball_security_score": 0.10, "passing_score": 0.12, "assist_score": 0.08, "attack_score": 0.05, "foul_card_score": 0.13},
    "GK": {"goalkeeper_score": 0.60, "defense_score": 0.15, "conceded_score": 0.15, "foul_card_score": 0.10},
    "OTHER": {"attack_score": 0.20, "assist_score": 0.20, "passing_score": 0.15, "defense_score": 0.15, "foul_card_score": 0.10, "aerial_score": 0.10, "conceded_score": 0.10},
}
#: Weights of the plain rating.
LEGACY_WEIGHTS = {"goals_assists_per_90": 1.0, "goals_per_90_overall": 0.7, "assists_per_90_overall": 0.7, "clean_sheets_per_90_derived": 0.6, "cards_per_90_derived": -0.5, "cards_per_90_overall": -0.3, "conceded_per_90_overall": -0.6, "red_cards_per_90_derived": -0.3}
#: Other names of the club column, best first, and rating columns that are taken as they are.
CLUBS = ["current club", "current_club", "Current Club", "club", "club_name", "team", "team_name", "squad"]
RATINGS = ["average_rating_overall", "rating", "rating_overall", "rating_pred"]


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def choose_position(df: DataFrame, candidates: Sequence[str] = ("position_group", "position"), wanted: Sequence[str] | None = None) -> str | None:
    """The candidate column with the most buckets (of those ``wanted``, if given) recognised in it; OTHER doesn't count,
    and of equals the first is taken."""
    have = [c for c in candidates if c in df.columns]
    if not have:
        return None
    use = lambda c: (position_bucket(c) != "OTHER") & (position_bucket(c).isin(list(wanted)) if wanted is not None else F.lit(True))
    found = df.agg(*[F.count_distinct(F.when(use(c), position_bucket(c))).alias(c) for c in have]).first()
    best = max(have, key=lambda c: found[c])
    return best if found[best] else None


def of_positions(df: DataFrame, positions: str | Sequence[str], candidates: Sequence[str] = ("position_group", "position")) -> DataFrame:
    """Rows whose bucket is one of ``positions``; all rows if no candidate column has any of these."""
    wanted = sorted({p.upper() for p in ([positions] if isinstance(positions, str) else positions)})
    column = choose_position(df, candidates, wanted)
    return df if column is None else df.where(position_bucket(column).isin(wanted))


def fill_position_group(df: DataFrame, group: str = "position_group", positions: Sequence[str] = ("position", "postion")) -> DataFrame:
    """``group`` as a bucket; where it is missing (also as a word), that of the first of ``positions`` that is there.

    Groups are read like positions, which don't know the word FWD: filled forwards end as OTHER, as published.
    """
    own = F.col(group).cast("string") if group in df.columns else F.lit(None).cast("string")
    source = next((p for p in positions if p in df.columns), None)
    missing = own.isNull() | F.lower(own).isin("none", "nan", "")
    filled = F.when(missing, position_bucket(source) if source else F.lit("OTHER")).otherwise(own)
    return df.withColumn(group, position_bucket(filled))


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights that sum to 1; as they are if their sum isn't positive."""
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()} if total > 0 else dict(weights)


def derived(df: DataFrame, minutes: str = "minutes_played_overall", games: str = "appearances_overall") -> DataFrame:
    """Add nineties and minutes per appearance where their columns are there."""
    if minutes in df.columns:
        df = df.withColumn("nineties", F.col(minutes) / 90.0)
        if games in df.columns:
            df = df.withColumn("minutes_per_appearance", F.col(minutes) / F.nullif(F.col(games), F.lit(0)))
    return df


def feature_matrix(df: DataFrame, drop: Sequence[str] = ("player_id", "full_name"), numeric_only: bool = False, positions: str | Sequence[str] | None = None) -> DataFrame:
    """The rows of ``positions`` (None: all) with the columns that hold values and the derived ones, without ``drop``."""
    out = drop_empty(df if positions is None else of_positions(df, positions))
    out = derived(out).drop(*drop)
    return out.select(*[f"`{c}`" for c, k in out.dtypes if k in NUMBERS or k.startswith("decimal")]) if numeric_only else out


def load_feature_matrix(spark: SparkSession, path: str, **how) -> tuple[DataFrame, list[str]]:
    """:func:`feature_matrix` of a table, and the names of its columns."""
    out = feature_matrix(read_table(spark, path), **how)
    return out, out.columns


def load_ratings(spark: SparkSession, path: str, **how) -> DataFrame:
    """:func:`teacher_rating` of a table."""
    return teacher_rating(read_table(spark, path), **how)


def load_targets(spark: SparkSession, path: str, **how) -> DataFrame:
    """:func:`targets` of a table with its derived columns."""
    return targets(derived(read_table(spark, path)), **how)


def targets(df: DataFrame, components: Mapping[str, Sequence[tuple[str, float]]] = COMPONENTS, allowed: Mapping[str, Sequence[str]] = ALLOWED, groups: Sequence[str] = ("season", "position_bucket"), minutes: str = "minutes_played_overall", positions: Sequence[str] = ("position_group", "position"), shrink: bool = True, z: bool = True, percentile: bool = False, scale: float = 10.0, unshrunk: Sequence[str] = ("appearance_score",), league: bool = False) -> DataFrame:
    """Add each component's score and ``position_bucket``.

    First components, those not allowed for the bucket nulled, shrunk by minutes to the group's mean, as z-scores within
    the group, and, if asked, as percentile ranks.  Without a position column all is OTHER and nothing further is done.
    """
    clash = [c for c in components if c in df.columns]
    if clash:
        raise ValueError(f"columns are there already: {', '.join(clash)}")
    out = component_scores(df, components)
    names = list(components)
    position = choose_position(df, positions)
    if position is None:
        return out.withColumn("position_bucket", F.lit("OTHER"))
    out = out.withColumn("position_bucket", position_bucket(position))
    out = out.withColumns({n: F.when(F.col("position_bucket").isin([b for b, cs in allowed.items() if n in cs]), F.col(n)) for n in names})
    keys = [g for g in groups if g in out.columns] + (["league"] if league and "league" in out.columns and "league" not in groups else [])
    if shrink and minutes in df.columns:
        out = shrink_by_volume(out, {n: n for n in names if n not in unshrunk}, minutes, keys)
    if z:
        out = z_scores(out, {n: n for n in names}, keys)
    if percentile:
        for n in names:
            out = percentile_ranks(out.withColumnRenamed(n, "_raw"), "_raw", n, keys, scale).drop("_raw")
    return out


def scores(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), percentile: bool = True, sigmoid: bool = True) -> DataFrame:
    """Add ``<name>_score_pct`` and ``<name>_score_sigmoid`` for each column."""
    if percentile:
        df = calibrated_scores(df, {f"{c}_score_pct": c for c in columns}, keys)
    if sigmoid:
        df = calibrated_scores(df, {f"{c}_score_sigmoid": c for c in columns}, keys, soft=4.0)
    return df


def scored_table(df: DataFrame, components: Mapping[str, Sequence[tuple[str, float]]] = COMPONENTS, allowed: Mapping[str, Sequence[str]] = ALLOWED, weights: Mapping[str, Mapping[str, float]] = RATING_WEIGHTS, drop: Sequence[str] = ("passing_score", "defense_score", "aerial_score"), keys: Sequence[str] = ("season", "position_bucket"), **how) -> DataFrame:
    """Targets, displayed rating, calibrated scores of all of them, and one club column from its other names."""
    base = targets(derived(df), components, allowed, keys, **how)
    base = base.withColumn("rating_display", rating("position_bucket", weights, list(components), drop))
    group = [k for k in keys if k in base.columns]
    out = scores(base, [*components, "rating_display"], group)
    clubs = [c for c in unique_names(CLUBS) if c.lower() in {x.lower() for x in out.columns}]
    if clubs:
        out = out.withColumn("_club", F.coalesce(*[F.col(f"`{c}`") for c in clubs])).drop(*clubs).withColumnRenamed("_club", "current_club")
    return out


def legacy_rating(df: DataFrame, weights: Mapping[str, float] = LEGACY_WEIGHTS) -> DataFrame:
    """Add ``rating_pred``: an explicit rating column where there is one, else the weighted z-scores around 5."""
    for c in RATINGS:
        if c in df.columns:
            return df.withColumn("rating_pred", F.col(c).try_cast("double"))
    use = {c: w for c, w in weights.items() if c in df.columns}
    z = z_scores(df, {f"_z_{c}": c for c in use})
    return z.withColumn("rating_pred", linear_score([(f"_z_{c}", w) for c, w in use.items()])).drop(*[f"_z_{c}" for c in use])


def teacher_rating(df: DataFrame, components: Mapping[str, Sequence[tuple[str, float]]] = COMPONENTS, allowed: Mapping[str, Sequence[str]] = ALLOWED, groups: Sequence[str] = ("season", "position_bucket"), minutes: str = "minutes_played_overall", positions: Sequence[str] = ("position_group", "position"), unused: Sequence[str] = ("appearance_score",), z: bool = True) -> DataFrame:
    """Add ``rating_pred``: the first component, fitted within each bucket, of the components allowed there."""
    for c in RATINGS:
        if c in df.columns:
            return df.withColumn("rating_pred", F.col(c).try_cast("double"))
    out = component_scores(df, components)
    position = choose_position(df, positions)
    out = out.withColumn("position_bucket", position_bucket(position) if position else F.lit("OTHER"))
    parts: dict[tuple, list[str]] = {}
    for bucket, cs in allowed.items():
        parts.setdefault(tuple(c for c in cs if c in components and c not in unused), []).append(bucket)
    value = F.lit(None).cast("double")
    made = []
    for i, (cs, buckets) in enumerate(parts.items()):
        out = component_scores(out, {f"_r{i}": [(c, 1.0) for c in cs]}, ["position_bucket"])
        value = F.when(F.col("position_bucket").isin(buckets), F.col(f"_r{i}")).otherwise(value)
        made.append(f"_r{i}")
    out = out.withColumn("rating_pred", value).drop(*made, *components)
    keys = [g for g in groups if g in out.columns]
    if minutes in out.columns:
        out = shrink_by_volume(out, {"rating_pred": "rating_pred"}, minutes, keys)
    return z_scores(out, {"rating_pred": "rating_pred"}, keys) if z else out


