"""The named reads over result tables made from the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import serve
from plumbline.queries.registry import query

_DIMS = ["attacking_tempo", "possession_dominance", "high_pressing", "set_piece_reliance", "vertical_threat", "defensive_positioning", "wide_play", "physicality"]
_PLAYER = {"player_row_id": "c_custkey", "player_id": "c_custkey % 100", "full_name": "c_name", "age": "c_nationkey + 18", "league": "c_mktsegment", "season": "CASE WHEN c_nationkey % 2 = 0 THEN '2020/2021' ELSE '2021/2022' END", "position": "CASE WHEN c_nationkey % 3 = 0 THEN 'Forward' ELSE 'Midfielder' END", "Current Club": "c_mktsegment", "minutes_played_overall": "c_acctbal", "nationality": "c_nationkey"}
_MATCH = {
    "player_row_id": "c_custkey", "player_id": "c_custkey % 10", "full_name": "c_name", "player_season": "CASE WHEN s_suppkey % 2 = 0 THEN '2020/2021' ELSE '2021/2022' END", "current_club": "c_mktsegment", "position": "c_mktsegment", "match_role_group": "'FW'", "team_row_id": "s_suppkey", "team_name": "s_name", "team_common_name": "s_name", "team_country": "s_nationkey",
    "team_season": "'2020/2021'", "team_style_cluster_id": "s_nationkey % 4", "team_style_cluster_label": "s_name", "match_scope": "'global'", "match_percentage": "100 - abs(c_acctbal - s_acctbal) / 200", "style_distance": "c_custkey * 1000000 + s_suppkey", "is_current_club_match": "0",
}
_STYLE = {k: v for k, v in _PLAYER.items() if k != "player_row_id"} | {"role": "CASE WHEN c_nationkey % 2 = 0 THEN 'FW' ELSE 'MF' END", "cluster_id": "c_nationkey % 5"}
_TEAM = {"team_row_id": "s_suppkey", "source_team_rowid": "s_suppkey", "team_name": "s_name", "common_name": "s_name", "country": "s_nationkey", "season": "CASE WHEN s_suppkey % 2 = 0 THEN '2020/2021' ELSE '2021/2022' END", "style_cluster_id": "s_nationkey % 4", "style_cluster_label": "s_name", **{d: f"s_acctbal + {i}" for i, d in enumerate(_DIMS)}, "style_data_quality": "s_acctbal / 100"}
#: Result tables: where they come from and what their columns are, in expressions that Spark and DuckDB share.
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "base_scores": ("customer", {c: {"player_id": "c_custkey % 100", "full_name": "c_name", "position": "c_mktsegment", "position_group": "CASE WHEN c_nationkey % 2 = 0 THEN 'FWD' ELSE 'MID' END", "current club": "c_mktsegment", "league": "c_mktsegment", "season": _PLAYER["season"], "minutes_played_overall": "c_custkey", "rating_display_score_pct": "CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END"}.get(c, f"c_acctbal + {i}") for i, c in enumerate(serve.SCORE_COLUMNS)}),
    "ml_player_predicted_team_style": ("customer", _PLAYER | {"match_role_group": "'FW'"} | {f"predicted_{d}": f"c_acctbal + {i}" for i, d in enumerate(_DIMS)}),
    "ml_team_profile_predicted_style": ("supplier", _TEAM),
    "player_top_team_matches": ("customer JOIN supplier ON c_nationkey = s_nationkey", _MATCH),
    "player_realistic_team_matches": ("customer JOIN supplier ON c_nationkey = s_nationkey", _MATCH | {"best_fit_dimensions": "'physicality'", "weak_fit_dimensions": "'wide_play'"} | {f"dimension_gap_{d}": f"abs(s_acctbal) + {i}" for i, d in enumerate(_DIMS)}),
    "team_top_player_matches": ("customer JOIN supplier ON c_nationkey = s_nationkey", _MATCH),
    "current_club_match_audit": ("customer JOIN supplier ON c_nationkey = s_nationkey", {k: v for k, v in _MATCH.items() if k in ("player_id", "full_name", "team_season", "match_percentage", "style_distance")}),
    "player_style_cards": ("customer", _STYLE),
    "player_cluster_summary": ("(SELECT DISTINCT c_nationkey FROM customer)", {"role": _STYLE["role"], "cluster_id": "c_nationkey", "player_count": "c_nationkey + 1"}),
    "player_role_summary": ("region", {c: {"role": "r_name", "role_name": "r_name"}.get(c, f"r_regionkey + {i}") for i, c in enumerate(serve.ROLE_COLUMNS)} | {"scanned_k_scores": "r_name"}),
    "team_style_clusters": ("supplier", _TEAM),
    "team_style_cluster_summary": ("nation", {"style_cluster_id": "n_nationkey", "label": "n_name"}),
    "team_style_dimension_feature_weights": ("nation", {"dimension": "n_regionkey", "feature_name": "n_name", "global_normalized_weight": "n_nationkey"}),
}
_MADE_FROM = ["customer", "supplier", "nation", "region"]


def tables(t) -> dict:
    """Every result table, lazily."""
    spark = t("nation").sparkSession
    for n in _MADE_FROM:
        t(n).createOrReplaceTempView(n)
    return {name: spark.sql(_select(name, "`")) for name in TABLES}


def _select(name: str, quote: str) -> str:
    source, columns = TABLES[name]
    return "SELECT " + ", ".join(f"{e} AS {quote}{c}{quote}" for c, e in columns.items()) + f" FROM {source}"


def _add(name: str, read: str, where: str, limit: int | None = None, ties: str = "", **given) -> None:
    """The query ``name``: the read with ``given``; in SQL its table with ``where``."""
    r = serve.READS[read]
    order = ", ".join(f'"{c}" {"DESC NULLS LAST" if way == "desc" else "ASC NULLS FIRST"}' for c, way in r.order)
    most = f" LIMIT {limit or serve.LIMIT}" if r.most is not None else ""
    shown = ", ".join(f'"{c}"' for c in r.columns) if r.columns else "*"
    sql = f"SELECT {shown} FROM ({_select(r.table, chr(34))}) AS x WHERE {where}" + (f" ORDER BY {order}{ties}" if order else "") + most
    query(name, sql)(lambda t: r(tables(t), limit, **given))


_add("read_players", "players", "season = '2020/2021' AND position_group = 'FWD' AND full_name ILIKE '%customer#%'", 100, q="customer#", season="2020/2021", position_group="fwd")
_add("read_player", "player", "player_id = 7", player_id=7)
_add("read_player_search", "player_search", "season = '2020/2021' AND position ILIKE '%ward%' AND \"Current Club\" = 'BUILDING'", season="2020/2021", position="ward", current_club="BUILDING")
_add("read_team_search", "team_search", "country = 3 AND (team_name ILIKE '%supplier%' OR common_name ILIKE '%supplier%')", q="supplier", country=3)
_add("read_top_matches", "top_matches", "player_id = 5 AND player_season = '2020/2021'", player_id=5, season="2020/2021")
_add("read_realistic_matches", "realistic_matches", "player_id = 5", 50, player_id=5)
_add("read_team_matches", "team_matches", "team_row_id = 4", team_row_id=4)
_add("read_club_audit", "club_audit", "full_name ILIKE '%customer%'", q="customer")
_add("read_player_style_search", "player_style_search", "role = 'FW' AND season = '2020/2021'", q="", role="fw", season="2020/2021")
_add("read_player_style", "player_style", "player_id = 8", player_id=8)
_add("read_player_clusters", "player_clusters", "role = 'MF'", role="mf")
_add("read_player_roles", "player_roles", "TRUE")
_add("read_team_style_search", "team_style_search", "style_cluster_id = 0", cluster_id=0)
_add("read_team_style", "team_style", "source_team_rowid = 3", source_team_rowid=3)
_add("read_team_clusters", "team_clusters", "TRUE")
_add("read_dimensions", "dimensions", "TRUE")


@query("read_stats", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM ({_select(x, chr(34))}) AS x" for n, x in serve.STATS.items() if n != "club_audit_entries") + " UNION ALL SELECT 'club_audit_entries', NULL::BIGINT")
def read_stats(t):
    made = tables(t)
    del made["current_club_match_audit"]
    return serve.stats(made)


@query("read_health", "SELECT 'ok' AS status, TRUE AS scores_exist, TRUE AS matching_exists, FALSE AS model_quality_exists, FALSE AS sample_mode")
def read_health(t):
    return serve.health(t("nation").sparkSession, tables(t)).select("status", *[F.col(c) for c in ("scores_exist", "matching_exists", "model_quality_exists", "sample_mode")])
