"""Principal components, targets by position and the scored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import linalg, stats
from plumbline.plans import scoring
from plumbline.queries.registry import query, r6, rounded, sr


def lines(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"), F.when(F.col("l_orderkey") % 13 != 0, F.col("l_quantity")).alias("c"))


_L = "l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b, CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity END AS c FROM lineitem)"
_Z = "s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc FROM l), sc AS (SELECT sqrt(avg((coalesce(c, mc) - mc) * (coalesce(c, mc) - mc))) AS sc FROM l, s), z AS MATERIALIZED (SELECT l_orderkey, l_linenumber, (a - ma) / sa AS za, (b - mb) / sb AS zb, (coalesce(c, mc) - mc) / sc AS zc FROM l, s, sc)"


@query("component_pca_1col", f"WITH {_L}, {_Z} SELECT l_orderkey, l_linenumber, {sr('-za')} AS score FROM z")
def component_pca_1col(t):
    return rounded(linalg.component_scores(lines(t), {"score": [("a", -1.0)]}).select("l_orderkey", "l_linenumber", "score"), "score")


@query("component_pca_2col", f"WITH {_L}, {_Z} SELECT l_orderkey, l_linenumber, {sr('(za + zb) / sqrt(2)')} AS score FROM z")
def component_pca_2col(t):
    return rounded(linalg.component_scores(lines(t), {"score": [("a", 1.0), ("b", 1.0), ("absent", 1.0)]}).select("l_orderkey", "l_linenumber", "score"), "score")


_R = "r AS MATERIALIZED (SELECT avg(za * zb) AS ab, avg(za * zc) AS ac, avg(zb * zc) AS bc FROM z)"
_STEP = ["x + ab * y + ac * w", "ab * x + y + bc * w", "ac * x + bc * y + w"]


@query(
    "component_pca_3col",
    f"""
WITH RECURSIVE {_L}, {_Z}, {_R}, p(n, x, y, w) AS (SELECT 0, 1.0::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE UNION ALL SELECT n + 1, ({_STEP[0]}) / k, ({_STEP[1]}) / k, ({_STEP[2]}) / k FROM (SELECT n, x, y, w, ab, ac, bc, sqrt(({_STEP[0]}) ** 2 + ({_STEP[1]}) ** 2 + ({_STEP[2]}) ** 2) AS k FROM p, r WHERE n < 300)),
v AS (SELECT x * sign(x + y + w) AS x, y * sign(x + y + w) AS y, w * sign(x + y + w) AS w FROM p WHERE n = 300)
SELECT l_orderkey, l_linenumber, {sr("za * x + zb * y + zc * w")} AS score FROM z, v
""",
)
def component_pca_3col(t):
    return rounded(linalg.component_scores(lines(t), {"score": [("a", 1.0), ("b", 1.0), ("c", 1.0)]}).select("l_orderkey", "l_linenumber", "score"), "score")


# customers in years as players in seasons
_COMPONENTS = {"attack_score": [("value", 1.0)], "conceded_score": [("late", -1.0)], "appearance_score": [("volume", 1.0)]}
_ALLOWED = {"GK": ["conceded_score", "appearance_score"], "DEF": ["attack_score", "conceded_score", "appearance_score"], "FWD": ["attack_score", "appearance_score"], "OTHER": ["attack_score", "appearance_score"]}
_WEIGHTS = {"GK": {"conceded_score": 1.0}, "DEF": {"attack_score": 0.4, "conceded_score": 0.6}, "FWD": {"attack_score": 0.7, "passing_score": 0.3}}
_POSITIONS = "CASE c_nationkey % 4 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'Defender' WHEN 2 THEN 'Striker' ELSE 'Winger' END"


def seasons(t):
    o = t("orders").groupBy("o_custkey", F.year("o_orderdate").cast("string").alias("season")).agg(F.avg("o_totalprice").alias("value"), F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("late"), (F.count(F.lit(1)) * 90).cast("double").alias("volume"))
    return o.join(t("customer").select("c_custkey", F.expr(_POSITIONS).alias("position")), F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")


def _targets() -> str:
    z0 = ", ".join(f"{'-' if w < 0 else ''}(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0)) AS {n}" for n, [(c, w)] in _COMPONENTS.items())
    mask = ", ".join(f"CASE WHEN position_bucket IN ({', '.join(repr(b) for b, cs in _ALLOWED.items() if n in cs)}) THEN {n} END AS {n}" for n in _COMPONENTS)
    shrunk = ", ".join(f"volume / (volume + coalesce(k, ka, 1)) * {n} + (1 - volume / (volume + coalesce(k, ka, 1))) * avg({n}) OVER g AS {n}" if n != "appearance_score" else n for n in _COMPONENTS)
    z1 = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN coalesce(({n} - avg({n}) OVER g) / nullif(stddev_pop({n}) OVER g, 0), 0) END AS {n}" for n in _COMPONENTS)
    bucket = "CASE position WHEN 'Goalkeeper' THEN 'GK' WHEN 'Defender' THEN 'DEF' WHEN 'Striker' THEN 'FWD' ELSE 'OTHER' END AS position_bucket"
    return f"""
y AS (SELECT c_custkey, {_POSITIONS} AS position, year(o_orderdate)::VARCHAR AS season, avg(o_totalprice) AS value, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END)::DOUBLE AS late, (count(*) * 90)::DOUBLE AS volume FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
y0 AS (SELECT c_custkey, season, volume, {bucket}, {z0} FROM y), y1 AS (SELECT c_custkey, season, volume, position_bucket, {mask} FROM y0),
k AS (SELECT season, position_bucket, nullif(median(volume), 0) AS k FROM y1 GROUP BY ALL), y2 AS (SELECT y1.*, k FROM y1 JOIN k USING (season, position_bucket)), y3 AS (SELECT *, (SELECT median(k) FROM y2) AS ka FROM y2),
y4 AS (SELECT c_custkey, season, position_bucket, {shrunk} FROM y3 WINDOW g AS (PARTITION BY season, position_bucket)), tg AS (SELECT c_custkey, season, position_bucket, {z1} FROM y4 WINDOW g AS (PARTITION BY season, position_bucket))"""


@query("targets_pipeline", f"WITH {_targets()} SELECT c_custkey, season, position_bucket, {', '.join(f'{sr(n)} AS {n}' for n in _COMPONENTS)} FROM tg")
def targets_pipeline(t):
    out = scoring.targets(seasons(t), _COMPONENTS, _ALLOWED, minutes="volume", positions=["position"])
    return rounded(out.select("c_custkey", "season", "position_bucket", *_COMPONENTS), *_COMPONENTS)


def _rating() -> str:
    cases = []
    for b, ws in _WEIGHTS.items():
        use = [(n, w) for n, w in ws.items() if n in _COMPONENTS]
        cases.append(f"WHEN '{b}' THEN ({' + '.join(f'coalesce({n}, 0) * {w}' for n, w in use)}) / nullif({' + '.join(f'CASE WHEN {n} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END' for n, w in use)}, 0)")
    every = ["attack_score", "conceded_score"]
    equal = f"({' + '.join(f'coalesce({n}, 0)' for n in every)}) / nullif({' + '.join(f'CASE WHEN {n} IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END' for n in every)}, 0)"
    return f"coalesce(CASE position_bucket {' '.join(cases)} END, {equal})"


def _scored() -> str:
    g = "season, position_bucket"
    scale = lambda mad, std: f"coalesce(nullif(1.4826 * {mad}, 0), nullif({std}, 0), 1.0)"
    return f"""
WITH {_targets()}, e AS (SELECT *, {_rating()} AS x FROM tg),
o1 AS (SELECT median(x) AS m, stddev_pop(x) AS s FROM e), o2 AS (SELECT median(abs(x - m)) AS d FROM e, o1),
g1 AS (SELECT {g}, median(x) AS m, stddev_samp(x) AS s, count(x) AS n FROM e GROUP BY ALL), g2 AS (SELECT {g}, median(abs(x - m)) AS d FROM e JOIN g1 USING ({g}) GROUP BY ALL),
z AS (SELECT c_custkey, {g}, x, n, (x - g1.m) / {scale("g2.d", "g1.s")} AS zg, (x - o1.m) / {scale("o2.d", "o1.s")} AS zo FROM e JOIN g1 USING ({g}) JOIN g2 USING ({g}), o1, o2),
qg AS (SELECT {g}, coalesce(nullif(quantile_cont(abs(zg), 0.9), 0), 1.0) AS q FROM z GROUP BY ALL), qo AS (SELECT coalesce(nullif(quantile_cont(abs(zo), 0.9), 0), 1.0) AS q FROM z),
b AS (SELECT c_custkey, {g}, x, n / (n + 50.0::DOUBLE) AS w, zg, zo, qg.q AS qg, qo.q AS qo FROM z JOIN qg USING ({g}), qo)
SELECT c_custkey, {g}, {sr("x")} AS rating_display, {sr("CASE WHEN x IS NOT NULL THEN least(greatest(5 + 4 * tanh((w * zg + (1 - w) * zo) / (w * qg + (1 - w) * qo)), 0), 10) END")} AS rating_display_score_pct FROM b
"""


@query("scored_dataset", _scored())
def scored_dataset(t):
    base = scoring.targets(seasons(t), _COMPONENTS, _ALLOWED, minutes="volume", positions=["position"])
    from plumbline.functions.exprs import rating

    rated = base.withColumn("rating_display", rating("position_bucket", _WEIGHTS, list(_COMPONENTS), ["appearance_score"]))
    out = scoring.scores(rated, ["rating_display"], ["season", "position_bucket"], sigmoid=False)
    return rounded(out.select("c_custkey", "season", "position_bucket", "rating_display", "rating_display_score_pct"), "rating_display", "rating_display_score_pct")


def _scored_full() -> str:
    names, g = [*_COMPONENTS, "rating_display"], "f, season, position_bucket"
    scale = lambda mad, std: f"coalesce(nullif(1.4826 * {mad}, 0), nullif({std}, 0), 1.0)"
    soft = lambda z: f"CASE WHEN kind = 'sigmoid' THEN 4 * tanh({z} / 4) ELSE {z} END"
    cells = " UNION ALL ".join(f"SELECT c_custkey, season, position_bucket, '{n}' AS f, {n} AS x FROM e" for n in names)
    shown = ", ".join(f"{sr(f'max(CASE WHEN f = {n!r} AND kind = {k!r} THEN v END)')} AS {n}_score_{k}" for n in names for k in ("pct", "sigmoid"))
    return f"""
WITH {_targets()}, e AS (SELECT *, {_rating()} AS rating_display FROM tg), l AS MATERIALIZED ({cells}),
o1 AS (SELECT f, median(x) AS m, stddev_pop(x) AS s FROM l GROUP BY f), o2 AS (SELECT f, median(abs(x - m)) AS d FROM l JOIN o1 USING (f) GROUP BY f),
g1 AS (SELECT {g}, median(x) AS m, stddev_samp(x) AS s, count(x) AS n FROM l GROUP BY ALL), g2 AS (SELECT {g}, median(abs(x - m)) AS d FROM l JOIN g1 USING ({g}) GROUP BY ALL),
z0 AS (SELECT c_custkey, {g}, x, n, (x - g1.m) / {scale("g2.d", "g1.s")} AS zg, (x - o1.m) / {scale("o2.d", "o1.s")} AS zo FROM l JOIN g1 USING ({g}) JOIN g2 USING ({g}) JOIN o1 USING (f) JOIN o2 USING (f)),
z AS MATERIALIZED (SELECT c_custkey, {g}, x, n, kind, {soft("zg")} AS zg, {soft("zo")} AS zo FROM z0, (VALUES ('pct'), ('sigmoid')) AS k(kind)),
qg AS (SELECT {g}, kind, coalesce(nullif(quantile_cont(abs(zg), 0.9), 0), 1.0) AS q FROM z GROUP BY ALL), qo AS (SELECT f, kind, coalesce(nullif(quantile_cont(abs(zo), 0.9), 0), 1.0) AS q FROM z GROUP BY ALL),
b AS (SELECT c_custkey, {g}, kind, x, n / (n + 50.0::DOUBLE) AS w, zg, zo, qg.q AS qg, qo.q AS qo FROM z JOIN qg USING ({g}, kind) JOIN qo USING (f, kind)),
v AS (SELECT c_custkey, {g}, kind, CASE WHEN x IS NOT NULL THEN least(greatest(5 + 4 * tanh((w * zg + (1 - w) * zo) / (w * qg + (1 - w) * qo)), 0), 10) END AS v FROM b)
SELECT c_custkey, season, position_bucket, {shown} FROM v GROUP BY c_custkey, season, position_bucket
"""


@query("scored_table_full", _scored_full())
def scored_table_full(t):
    """The whole plan with both kinds of score for all components."""
    out = scoring.scored_table(seasons(t), _COMPONENTS, _ALLOWED, _WEIGHTS, (), minutes="volume", positions=["position"])
    shown = [c for c in out.columns if c.endswith(("_pct", "_sigmoid"))]
    return rounded(out.select("c_custkey", "season", "position_bucket", *shown), *shown)


@query("of_positions", "SELECT c_custkey FROM customer WHERE c_nationkey % 4 IN (0, 2)")
def of_positions(t):
    c = t("customer").select("c_custkey", F.lit("unknown").alias("position_group"), F.expr(_POSITIONS).alias("position"))
    return scoring.of_positions(c, ["gk", "fwd"]).select("c_custkey")


@query("filled_position_groups", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 2 THEN 'MID' WHEN c_nationkey % 4 = 0 THEN 'GK' WHEN c_nationkey % 4 = 1 THEN 'DEF' ELSE 'OTHER' END AS position_group FROM customer")
def filled_position_groups(t):
    c = t("customer").select("c_custkey", F.expr("CASE c_nationkey % 3 WHEN 1 THEN 'none' WHEN 2 THEN 'MID' END").alias("position_group"), F.expr(_POSITIONS).alias("position"))
    return scoring.fill_position_group(c).select("c_custkey", "position_group")


@query("teacher_rating")
def teacher_rating(t):
    out = scoring.teacher_rating(seasons(t), _COMPONENTS, _ALLOWED, minutes="volume", positions=["position"])
    return rounded(out.select("c_custkey", "season", "position_bucket", "rating_pred"), "rating_pred")


@query("latent_dimensions", "WITH e AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(3)) + " FROM embeddings) SELECT vec_id, " + ", ".join(f"{sr(f'(rank() OVER (ORDER BY x{i}) + (count(*) OVER (PARTITION BY x{i}) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100')} AS latent_style_dim_{i + 1}" for i in range(3)) + ", 50.0::DOUBLE AS latent_style_dim_4 FROM e")
def latent_dimensions(t):
    from plumbline.plans.player_style import latent

    e = t("embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)])
    return rounded(latent(e, ["x0", "x1", "x2"], 4).select("vec_id", *[f"latent_style_dim_{i}" for i in range(1, 5)]), *[f"latent_style_dim_{i}" for i in range(1, 4)])


@query("auto_per90", f"SELECT l_orderkey, l_linenumber, {sr('l_quantity / nullif(l_tax, 0) * 90')} AS goals_auto_per90, l_extendedprice AS shots_per_90_overall FROM lineitem")
def auto_per90(t):
    from plumbline.functions.names import ROLE_FAMILIES
    from plumbline.plans.player_style import with_auto_rates

    li = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("goals_total_overall"), F.col("l_extendedprice").alias("shots_per_90_overall"), F.col("l_extendedprice").alias("shots_total_overall"), F.col("l_tax").alias("minutes"))
    return rounded(with_auto_rates(li, ROLE_FAMILIES["FW"], "minutes").select("l_orderkey", "l_linenumber", "goals_auto_per90", "shots_per_90_overall"), "goals_auto_per90")


@query("principal_components")
def principal_components(t):
    out, _ = linalg.principal_components(lines(t), ["a", "b", "c"])
    return out.select("l_orderkey", "l_linenumber", r6("pc_1").alias("pc_1"))


@query("group_stats_null_keys", "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS g, c_acctbal AS x FROM customer) SELECT c_custkey, g, " + sr("avg(x) OVER (PARTITION BY g)") + " AS mean, count(x) OVER (PARTITION BY g) AS n FROM c")
def group_stats_null_keys(t):
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("g"), F.col("c_acctbal").alias("x"))
    out = stats.with_stats(c, ["g"], {"mean": F.avg("x"), "n": F.count("x")})
    return rounded(out.select("c_custkey", "g", "mean", "n"), "mean")


@query("feature_matrix", "SELECT c_custkey AS row_number, c_acctbal AS minutes_played_overall, c_nationkey AS appearances_overall, " + sr("c_acctbal / 90") + " AS nineties, " + sr("c_acctbal / nullif(c_nationkey, 0)") + " AS minutes_per_appearance FROM customer WHERE c_nationkey % 4 = 1")
def feature_matrix(t):
    c = t("customer").select(F.col("c_custkey").alias("row_number"), F.col("c_custkey").alias("player_id"), F.col("c_name").alias("full_name"), F.col("c_acctbal").alias("minutes_played_overall"), F.col("c_nationkey").alias("appearances_overall"), F.lit(None).cast("double").alias("tackles_per_90_overall"), F.expr(_POSITIONS).alias("position"))
    return rounded(scoring.feature_matrix(c, numeric_only=True, positions="def"), "nineties", "minutes_per_appearance")
