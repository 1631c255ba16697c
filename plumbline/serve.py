"""Read queries: filters, order and limits over result tables, each a function to a DataFrame.

Text filters match any part of a value without regard to case; "%" and "_" in them are wildcards.  Nulls sort last
where the order falls and first where it rises.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT, MOST = 20, 100


class MissingTable(LookupError):
    """A result table that hasn't been built."""


class NotFound(LookupError):
    """A detail query without rows."""


def clamp(limit: int | None, most: int = 50, default: int = LIMIT) -> int:
    return max(1, min(default if limit is None else limit, most))


def checked(limit: int, most: int = MOST) -> int:
    """The limit itself if it is 1 to ``most``; others are an error."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


def like(columns: Sequence[str] | str, text: str) -> Column:
    """Any of the columns holds ``text``."""
    names = [columns] if isinstance(columns, str) else list(columns)
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(F.col(f"`{n}`").ilike(f"%{text}%"), F.lit(False))
    return out


def search(table: DataFrame, columns: Sequence[str] | None = None, equal: Mapping[str, object] | None = None, contains: Mapping[str | tuple[str, ...], str] | None = None, order: Sequence[tuple[str, str]] = (), limit: int | None = None) -> DataFrame:
    """Rows that pass every filter given (None: not given), in order, at most ``limit``.

    ``order`` has (column, "asc" or "desc"); the projection reaches the scan, and order with limit is a top-n.
    """
    out = table
    for c, v in (equal or {}).items():
        if v is not None:
            out = out.where(F.col(f"`{c}`") == F.lit(v))
    for c, v in (contains or {}).items():
        if v:
            out = out.where(like(list(c) if isinstance(c, tuple) else c, v))
    if order:
        out = out.orderBy(*[F.desc_nulls_last(c) if way == "desc" else F.asc_nulls_first(c) for c, way in order])
    if limit is not None:
        out = out.limit(limit)
    return out.select(*[F.col(f"`{c}`") for c in columns]) if columns else out


#: The columns that the read functions return.
SCORE_COLUMNS = ["player_id", "full_name", "position", "position_group", "current club", "league", "season", "minutes_played_overall", "appearances_overall", "goals_overall", "assists_overall", "clean_sheets_overall", "conceded_overall", "yellow_cards_overall", "red_cards_overall", "attack_score_score_pct", "assist_score_score_pct", "conceded_score_score_pct", "foul_card_score_score_pct", "goalkeeper_score_score_pct", "appearance_score_score_pct", "rating_display_score_pct", "rating_display_score_sigmoid"]
PLAYER_COLUMNS = ["player_row_id", "player_id", "full_name", "age", "league", "season", "position", "Current Club", "minutes_played_overall", "nationality", "match_role_group", "predicted_attacking_tempo", "predicted_possession_dominance", "predicted_high_pressing", "predicted_vertical_threat", "predicted_defensive_positioning", "predicted_physicality"]
TEAM_COLUMNS = ["team_row_id", "team_name", "common_name", "country", "season", "style_cluster_id", "style_cluster_label", "attacking_tempo", "possession_dominance", "high_pressing", "vertical_threat", "defensive_positioning", "physicality", "style_data_quality"]
MATCH_COLUMNS = ["player_row_id", "player_id", "full_name", "player_season", "current_club", "position", "match_role_group", "team_row_id", "team_name", "team_common_name", "team_country", "team_season", "team_style_cluster_id", "team_style_cluster_label", "match_scope", "match_percentage", "style_distance", "is_current_club_match"]
REALISTIC_COLUMNS = ["best_fit_dimensions", "weak_fit_dimensions", "dimension_gap_attacking_tempo", "dimension_gap_possession_dominance", "dimension_gap_high_pressing", "dimension_gap_vertical_threat", "dimension_gap_defensive_positioning", "dimension_gap_physicality"]
ROLE_COLUMNS = ["role", "role_name", "player_rows", "best_k", "silhouette", "explained_variance_ratio", "pca_components", "selected_feature_count", "hdbscan_noise_rate"]


@dataclass(frozen=True)
class Read:
    """A read of one result table: which arguments filter which columns, and in which order rows come.

    ``equal`` and ``contains`` map arguments to columns (several: any of them); those in ``upper`` are upper-cased.
    ``most`` is the highest limit (None: all rows); ``strict`` refuses limits outside it where others are clamped.
    ``single``: no row at all is :class:`NotFound`.
    """

    table: str
    order: Sequence[tuple[str, str]] = ()
    columns: Sequence[str] | None = None
    equal: Mapping[str, str] = field(default_factory=dict)
    contains: Mapping[str, str | tuple[str, ...]] = field(default_factory=dict)
    upper: Sequence[str] = ()
    most: int | None = 50
    strict: bool = False
    single: bool = False

    def __call__(self, tables: Mapping[str, DataFrame], limit: int | None = None, **given) -> DataFrame:
        unknown = set(given) - set(self.equal) - set(self.contains)
        if unknown:
            raise TypeError(f"unknown filters: {sorted(unknown)}")
        value = {k: v.upper() if k in self.upper and v else v for k, v in given.items()}
        if self.most is not None:
            limit = checked(LIMIT if limit is None else limit, self.most) if self.strict else clamp(limit, self.most)
        equal = {c: value.get(a) or (value.get(a) if value.get(a) == 0 else None) for a, c in self.equal.items()}
        contains = {c: value[a] for a, c in self.contains.items() if value.get(a)}
        out = search(required(tables, self.table), self.columns, equal, contains, self.order, limit)
        if self.single and out.isEmpty():
            raise NotFound(f"{self.table}: {given}")
        return out


_BEST, _WORST = [("match_percentage", "desc"), ("style_distance", "asc")], [("match_percentage", "asc"), ("style_distance", "desc")]
_BY_MINUTES, _BY_QUALITY = [("minutes_played_overall", "desc"), ("full_name", "asc")], [("style_data_quality", "desc"), ("team_name", "asc")]
_NAMES = ("team_name", "common_name")

#: The reads of scores, players, teams, matches and styles by name.
READS: dict[str, Read] = {
    "players": Read("base_scores", [("rating_display_score_pct", "desc"), ("minutes_played_overall", "desc")], SCORE_COLUMNS, {"season": "season", "league": "league", "position_group": "position_group", "current_club": "current club"}, {"q": "full_name"}, ["position_group"], MOST, True),
    "player": Read("base_scores", [("rating_display_score_pct", "desc"), ("season", "desc")], SCORE_COLUMNS, {"player_id": "player_id"}, most=None, single=True),
    "player_search": Read("ml_player_predicted_team_style", _BY_MINUTES, PLAYER_COLUMNS, {"season": "season", "current_club": "Current Club"}, {"q": "full_name", "position": "position"}),
    "team_search": Read("ml_team_profile_predicted_style", _BY_QUALITY, TEAM_COLUMNS, {"country": "country", "season": "season"}, {"q": _NAMES}),
    "top_matches": Read("player_top_team_matches", _BEST, MATCH_COLUMNS, {"player_id": "player_id", "season": "player_season"}),
    "realistic_matches": Read("player_realistic_team_matches", _BEST, [*MATCH_COLUMNS, *REALISTIC_COLUMNS], {"player_id": "player_id", "season": "player_season"}),
    "team_matches": Read("team_top_player_matches", _BEST, MATCH_COLUMNS, {"team_row_id": "team_row_id"}),
    "club_audit": Read("current_club_match_audit", _WORST, None, {"player_id": "player_id"}, {"q": "full_name"}),
    "player_style_search": Read("player_style_cards", _BY_MINUTES, None, {"role": "role", "season": "season"}, {"q": "full_name"}, ["role"]),
    "player_style": Read("player_style_cards", [("minutes_played_overall", "desc")], None, {"player_id": "player_id"}),
    "player_clusters": Read("player_cluster_summary", [("role", "asc"), ("cluster_id", "asc")], None, {"role": "role"}, upper=["role"], most=None),
    "player_roles": Read("player_role_summary", [("role", "asc")], ROLE_COLUMNS, most=None),
    "team_style_search": Read("team_style_clusters", _BY_QUALITY, None, {"country": "country", "season": "season", "cluster_id": "style_cluster_id"}, {"q": _NAMES}),
    "team_style": Read("team_style_clusters", (), None, {"source_team_rowid": "source_team_rowid"}, most=None, single=True),
    "team_clusters": Read("team_style_cluster_summary", [("style_cluster_id", "asc")], most=None),
    "dimensions": Read("team_style_dimension_feature_weights", [("dimension", "asc"), ("global_normalized_weight", "desc")], most=None),
}
#: What the counts of :func:`stats` are of.
STATS = {"player_style_profiles": "player_style_cards", "team_style_profiles": "team_style_clusters", "predicted_players": "ml_player_predicted_team_style", "predicted_teams": "ml_team_profile_predicted_style", "realistic_matches": "player_realistic_team_matches", "top_player_matches": "player_top_team_matches", "team_player_matches": "team_top_player_matches", "club_audit_entries": "current_club_match_audit"}


@dataclass(frozen=True)
class Settings:
    """Where result tables are (a folder with one Parquet table each), and the limits of reads."""

    folder: str
    default_limit: int = LIMIT
    most: int = 50

    @classmethod
    def of(cls, values: Mapping[str, str]) -> Settings:
        """From texts by name, such as environment variables: ``folder``, ``default_limit``, ``most``."""
        return cls(values["folder"], int(values.get("default_limit", LIMIT)), int(values.get("most", 50)))

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The tables of :data:`READS` and the model's that are there."""
        out = {}
        for name in {*(r.table for r in READS.values()), "ml_model_quality", "ml_experiment_summary"}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                out[name] = spark.read.parquet(f"{self.folder}/{name}")
        return out

    def read(self, spark: SparkSession, name: str, limit: int | None = None, **given) -> DataFrame:
        """A read of :data:`READS` over these tables, within these limits."""
        r = READS[name]
        if r.most is not None and not r.strict:
            r = replace(r, most=self.most)
        return r(self.tables(spark), self.default_limit if limit is None and r.most is not None else limit, **given)


def player_matches(tables: Mapping[str, DataFrame], player_id, season=None, realistic: bool = True, limit: int | None = None) -> DataFrame:
    """Best matches of a player, from the realistic ones unless told otherwise."""
    return READS["realistic_matches" if realistic else "top_matches"](tables, limit, player_id=player_id, season=season)


def stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name``, ``n``: rows of each result table, null for one that hasn't been built."""
    from plumbline.operators.profiles import table_counts

    return table_counts({name: tables.get(t) for name, t in STATS.items()})


def health(spark: SparkSession, tables: Mapping[str, DataFrame], metadata: bool = False, sample: bool = False) -> DataFrame:
    """One row: ``status``, and which of the main tables are there."""
    row = ("ok" if "player_top_team_matches" in tables else "missing_data", "base_scores" in tables, "player_top_team_matches" in tables, metadata or "ml_model_quality" in tables, sample)
    return spark.createDataFrame([row], "status string, scores_exist boolean, matching_exists boolean, model_quality_exists boolean, sample_mode boolean")


def detail(table: DataFrame, record: str, value, order: Sequence[tuple[str, str]] = (), limit: int | None = None) -> DataFrame:
    """Rows of one id; none is an error when ``limit`` is 1."""
    out = search(table, None, {record: value}, None, order, limit)
    if limit == 1 and out.isEmpty():
        raise NotFound(f"{record} = {value}")
    return out


def matches_of(table: DataFrame, record: str, value, season=None, season_column: str = "player_season", limit: int | None = None, worst: bool = False) -> DataFrame:
    """Matches of a player or team, best first (or worst first)."""
    order = [("match_percentage", "asc"), ("style_distance", "desc")] if worst else [("match_percentage", "desc"), ("style_distance", "asc")]
    return search(table, None, {record: value, season_column: season}, None, order, clamp(limit))


def dimensions(weights: DataFrame) -> DataFrame:
    return search(weights, None, order=[("dimension", "asc"), ("global_normalized_weight", "desc")])


def first_per_group(table: DataFrame, group: str, order: str, n: int = 6, tie: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows of each group by falling ``order``, then by rising ``tie`` (None: all other columns)."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(order), *[F.asc_nulls_first(c) for c in (tie or [c for c in table.columns if c not in (group, order)])])
    return table.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def fit_band(percent: Column | str) -> Column:
    p = F.col(percent) if isinstance(percent, str) else percent
    return F.when(p >= 70, "strong").when(p >= 50, "medium").when(p.isNotNull(), "weak")


def required(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    if name not in tables:
        raise MissingTable(name)
    return tables[name]


def model_quality(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row: scope, source, summary (struct) and metrics (array of structs) from the result tables."""
    summary, metrics = required(tables, "ml_experiment_summary"), required(tables, "ml_model_quality")
    m = metrics.agg(F.collect_list(F.struct(*metrics.columns)).alias("metrics"))  # a row a dimension
    return summary.limit(1).select(F.lit("ml_team_player_matching").alias("scope"), F.lit("tables").alias("source"), F.struct(*summary.columns).alias("summary")).crossJoin(F.broadcast(m))
