"""Robust scores, z-scores, shrinkage and percentile ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import exprs as x
from plumbline.operators import stats
from plumbline.queries.registry import query, r6, rounded, sr

# events' values with every 17th missing
_EVENTS = "e AS (SELECT event_id, event_type, user_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS x FROM events)"


def events(t):
    return t("events").select("event_id", "event_type", "user_id", F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("x"))


def _calibrated(soft: float | None) -> str:
    squash = lambda z: f"{soft} * tanh(({z}) / {soft})" if soft else z
    scale = lambda mad, std: f"coalesce(nullif(1.4826 * {mad}, 0), nullif({std}, 0), 1.0)"
    return f"""
WITH {_EVENTS},
o1 AS (SELECT median(x) AS m, stddev_pop(x) AS s FROM e), o2 AS (SELECT median(abs(x - m)) AS d FROM e, o1),
g1 AS (SELECT event_type, median(x) AS m, stddev_samp(x) AS s, count(x) AS n FROM e GROUP BY event_type),
g2 AS (SELECT event_type, median(abs(x - m)) AS d FROM e JOIN g1 USING (event_type) GROUP BY event_type),
z AS (SELECT event_id, event_type, x, n, {squash(f"(x - g1.m) / {scale('g2.d', 'g1.s')}")} AS zg, {squash(f"(x - o1.m) / {scale('o2.d', 'o1.s')}")} AS zo FROM e JOIN g1 USING (event_type) JOIN g2 USING (event_type), o1, o2),
qg AS (SELECT event_type, coalesce(nullif(quantile_cont(abs(zg), 0.9), 0), 1.0) AS q FROM z GROUP BY event_type), qo AS (SELECT coalesce(nullif(quantile_cont(abs(zo), 0.9), 0), 1.0) AS q FROM z),
b AS (SELECT event_id, event_type, x, n / (n + 50.0::DOUBLE) AS w, zg, zo, qg.q AS qg, qo.q AS qo FROM z JOIN qg USING (event_type), qo)
SELECT event_id, event_type, {sr("CASE WHEN x IS NOT NULL THEN least(greatest(5 + 4 * tanh((w * zg + (1 - w) * zo) / (w * qg + (1 - w) * qo)), 0), 10) END")} AS score FROM b
"""


@query("score_percentile", _calibrated(None))
def score_percentile(t):
    out = stats.calibrated_scores(events(t), {"score": "x"}, ["event_type"])
    return rounded(out.select("event_id", "event_type", "score"), "score")


@query("score_sigmoid", _calibrated(4.0))
def score_sigmoid(t):
    out = stats.calibrated_scores(events(t), {"score": "x"}, ["event_type"], soft=4.0)
    return rounded(out.select("event_id", "event_type", "score"), "score")


@query(
    "score_fixed_center",
    f"""
WITH z AS (SELECT o_orderkey, 4 * tanh((o_totalprice - 150000) / 50000.0::DOUBLE / 4) AS z FROM orders), q AS (SELECT coalesce(nullif(quantile_cont(abs(z), 0.9), 0), 1.0) AS q FROM z)
SELECT o_orderkey, {sr("least(greatest(5 + 4 * tanh(z / q), 0), 10)")} AS score FROM z, q
""",
)
def score_fixed_center(t):
    out = stats.calibrated_scores(t("orders"), {"score": "o_totalprice"}, soft=4.0, fixed=(150000.0, 50000.0))
    return rounded(out.select("o_orderkey", "score"), "score")


@query(
    "robust_zscore",
    f"""
WITH {_EVENTS}, g1 AS (SELECT event_type, median(x) AS m, stddev_samp(x) AS s FROM e GROUP BY event_type), g2 AS (SELECT event_type, median(abs(x - m)) AS d FROM e JOIN g1 USING (event_type) GROUP BY event_type)
SELECT event_id, {sr("(x - m) / coalesce(nullif(1.4826 * d, 0), nullif(s, 0), 1.0)")} AS z FROM e JOIN g1 USING (event_type) JOIN g2 USING (event_type)
""",
)
def robust_zscore(t):
    return rounded(stats.robust_z(events(t), {"z": "x"}, ["event_type"]).select("event_id", "z"), "z")


@query(
    "group_zscore",
    f"""
SELECT l_orderkey, l_linenumber, {sr("coalesce((l_extendedprice - avg(l_extendedprice) OVER w) / nullif(stddev_pop(l_extendedprice) OVER w, 0), 0)")} AS z
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)
""",
)
def group_zscore(t):
    out = stats.z_scores(t("lineitem"), {"z": "l_extendedprice"}, ["l_returnflag", "l_linestatus"])
    return rounded(out.select("l_orderkey", "l_linenumber", "z"), "z")


@query("global_zscore", f"WITH s AS (SELECT avg(c_acctbal) AS a, stddev_pop(c_acctbal) AS d FROM customer) SELECT c_custkey, {sr('CASE WHEN d = 0 THEN 0 ELSE (c_acctbal - a) / d END')} AS z FROM customer, s")
def global_zscore(t):
    return rounded(stats.z_scores(t("customer"), {"z": "c_acctbal"}).select("c_custkey", "z"), "z")


@query(
    "train_only_zscore",
    f"""
WITH o AS (SELECT o_orderkey, o_orderpriority AS g, o_totalprice AS x, year(o_orderdate) < 1997 AS t FROM orders),
a AS (SELECT avg(x) AS m, coalesce(nullif(stddev_pop(x), 0), 1) AS s FROM o WHERE t), b AS (SELECT g, avg(x) AS m, stddev_samp(x) AS s FROM o WHERE t GROUP BY g)
SELECT o_orderkey, {sr("(x - coalesce(b.m, a.m)) / coalesce(nullif(b.s, 0), a.s)")} AS z FROM o LEFT JOIN b USING (g), a
""",
)
def train_only_zscore(t):
    out = stats.train_only_z(t("orders"), "o_totalprice", "z", F.year("o_orderdate") < 1997, ["o_orderpriority"])
    return rounded(out.select("o_orderkey", "z"), "z")


@query(
    "shrink_by_volume",
    f"""
WITH n AS (SELECT o_custkey, count(*) AS m FROM orders GROUP BY o_custkey),
c AS (SELECT c_custkey, c_mktsegment AS g, c_acctbal AS x, coalesce(m, 0)::DOUBLE AS m FROM customer LEFT JOIN n ON o_custkey = c_custkey),
k AS (SELECT g, nullif(median(m), 0) AS k, avg(x) AS a FROM c GROUP BY g), o AS (SELECT median(k) AS k FROM c JOIN k USING (g)),
w AS (SELECT c_custkey, x, a, m / (m + coalesce(k.k, o.k, 1.0)) AS w FROM c JOIN k USING (g), o)
SELECT c_custkey, {sr("w * x + (1 - w) * a")} AS shrunk FROM w
""",
)
def shrink_by_volume(t):
    n = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("m"))
    c = t("customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("m", F.coalesce("m", F.lit(0)).cast("double"))
    out = stats.shrink_by_volume(c, {"shrunk": "c_acctbal"}, "m", ["c_mktsegment"])
    return rounded(out.select("c_custkey", "shrunk"), "shrunk")


@query(
    "percentile_rank",
    f"""
WITH {_EVENTS}, r AS (SELECT event_id, event_type, x, rank() OVER (PARTITION BY event_type ORDER BY x NULLS LAST) AS r, count(*) OVER (PARTITION BY event_type, x) AS ties, count(x) OVER (PARTITION BY event_type) AS n FROM e)
SELECT event_id, {sr("CASE WHEN x IS NOT NULL THEN (r + (ties - 1) / 2.0::DOUBLE) / n * 10 END")} AS pct FROM r
""",
)
def percentile_rank(t):
    out = stats.percentile_ranks(events(t), "x", "pct", ["event_type"], 10.0)
    return rounded(out.select("event_id", "pct"), "pct")


def _rank(over: str, least: int) -> str:
    part = f"PARTITION BY {over}" if over else ""
    ties = f"PARTITION BY {over}, x" if over else "PARTITION BY x"
    return f"CASE WHEN x IS NOT NULL AND count(x) OVER ({part}) >= {least} THEN (rank() OVER ({part} ORDER BY x NULLS LAST) + (count(*) OVER ({ties}) - 1) / 2.0::DOUBLE) / count(x) OVER ({part}) * 100 END"


@query(
    "hierarchical_percentile",
    f"""
WITH c AS (SELECT c_custkey, n_regionkey AS r, n_nationkey AS n, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS x FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, {sr(f"coalesce({_rank('r, n', 60)}, {_rank('r', 60)}, {_rank('', 2)}, 50)")} AS pct FROM c
""",
)
def hierarchical_percentile(t):
    c = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).withColumn("x", F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")))
    out = stats.hierarchical_percentile(c, "x", "pct", [["n_regionkey", "n_nationkey"], ["n_regionkey"]], 60)
    return rounded(out.select("c_custkey", "pct"), "pct")


@query(
    "sample_weight",
    f"""
WITH n AS (SELECT o_custkey, count(*)::DOUBLE AS a, sum(o_totalprice) / 10000 AS m FROM orders GROUP BY o_custkey),
c AS (SELECT c_custkey, c_mktsegment AS g, greatest(coalesce(m, 0), 0) AS m, greatest(coalesce(a, 0), 0) AS a FROM customer LEFT JOIN n ON o_custkey = c_custkey),
k AS (SELECT g, coalesce(nullif(median(m), 0), 1.0) AS km, coalesce(nullif(median(a), 0), 1.0) AS ka FROM c GROUP BY g)
SELECT c_custkey, {sr("least(greatest(0.2 + 1.8 * (m / (m + km)) * sqrt(a / (a + ka)), 0.2), 2.0)")} AS sample_weight FROM c JOIN k USING (g)
""",
)
def sample_weight(t):
    from plumbline.operators.splits import sample_weights

    n = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("a"), (F.sum("o_totalprice") / 10000).alias("m"))
    c = t("customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rounded(sample_weights(c, "m", "a", "c_mktsegment").select("c_custkey", "sample_weight"), "sample_weight")


@query(
    "half_life_percent",
    f"""
WITH d AS (SELECT event_id, abs(value - (SELECT avg(value) FROM events)) AS d FROM events), h AS (SELECT quantile_cont(d, 0.75) AS h FROM d WHERE d > 0)
SELECT event_id, {sr("least(greatest(100 * exp(ln(0.5) * pow(d / CASE WHEN h > 0 THEN h ELSE 1 END, 2)), 0), 100)")} AS percent FROM d, h
""",
)
def half_life_percent(t):
    e = stats.with_stats(t("events"), (), {"m": F.avg("value")}).withColumn("d", F.abs(F.col("value") - F.col("m")))
    h = stats.with_stats(e, (), {"h": stats.quantile(F.when(F.col("d") > 0, F.col("d")), 0.75)})
    return h.select("event_id", r6(x.half_life_percent("d", "h")).alias("percent"))
