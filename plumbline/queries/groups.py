"""Group profiles, reliability, quality, audits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import exprs as x
from plumbline.operators import matching, profiles
from plumbline.queries.registry import query, r6, rounded, sr

_F = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


def lines(t):
    """Order lines with every 13th discount missing, a missing-value sentinel and a constant."""
    n = F.col("l_orderkey") % 13
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.when(n != 0, F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"))
    return li.withColumns({"sparse": F.when(F.col("l_orderkey") % 5 == 0, F.lit(-1.0)).otherwise(F.col("l_linenumber").cast("double")), "constant": F.lit(3.0)})


_LINES = "l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity AS quantity, l_extendedprice AS price, CASE WHEN l_orderkey % 13 <> 0 THEN l_discount END AS discount, l_tax AS tax, CASE WHEN l_orderkey % 5 = 0 THEN -1.0::DOUBLE ELSE l_linenumber::DOUBLE END AS sparse, 3.0::DOUBLE AS constant FROM lineitem)"
_ALL = ["quantity", "price", "discount", "tax", "sparse", "constant"]


def _profile_sql() -> str:
    fs = ["price", "discount"]
    mean = ", ".join(f"sum({f} * w) / nullif(sum(CASE WHEN {f} IS NOT NULL THEN w END), 0) AS m_{f}" for f in fs)
    std = ", ".join(f"{sr(f'sqrt(greatest(sum(w * ({f} - m_{f}) * ({f} - m_{f})) / nullif(sum(CASE WHEN {f} IS NOT NULL THEN w END), 0), 0))')} AS std__{f}" for f in fs)
    pct = ", ".join(f"{sr(f'quantile_cont({f}, {p})')} AS {n}__{f}" for n, p in (("p25", 0.25), ("p75", 0.75)) for f in fs)
    return f"""
WITH {_LINES}, w0 AS (SELECT *, ln(1 + greatest(CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE quantity END, 0)) AS w0 FROM l), w AS (SELECT *, CASE WHEN max(w0) OVER (PARTITION BY l_suppkey) = 0 THEN 1 ELSE w0 END AS w FROM w0),
m AS (SELECT l_suppkey, {mean} FROM w GROUP BY l_suppkey)
SELECT l_suppkey, {", ".join(f"{sr(f'any_value(m_{f})')} AS mean__{f}" for f in fs)}, {std}, {pct}, count(*) AS rows_used, {sr("sum(w)")} AS weight_sum, 1.0::DOUBLE AS feature_coverage FROM w JOIN m USING (l_suppkey) GROUP BY l_suppkey
"""


@query("roster_profile", _profile_sql())
def roster_profile(t):
    li = lines(t).withColumn("w", F.log1p(F.greatest(F.when(F.col("l_suppkey") % 7 == 0, 0.0).otherwise(F.col("quantity")), F.lit(0.0))))
    out = profiles.weighted_profile(li, ["l_suppkey"], ["price", "discount"], "w")
    return rounded(out, *[f"{s}__{f}" for s in ("mean", "std", "p25", "p75") for f in ("price", "discount")], "weight_sum")


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


def _reliability_sql(source: str = "l") -> str:
    facts = _union([f"SELECT '{f}' AS feature_name, count({f})::DOUBLE / count(*) AS c, avg(CASE WHEN {f} IS NULL THEN NULL WHEN {f} <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS z, count(DISTINCT {f}) AS u, stddev_pop({f}) AS s, median(abs({f})) AS m FROM {source}" for f in _ALL])
    d = "least(u / 20.0::DOUBLE, 1)"
    e = "CASE WHEN s <= 0 THEN 0 ELSE s / (s + m + 1e-9) END"
    zero = lambda v: sr(f"CASE WHEN u > 1 THEN {v} ELSE 0 END")
    return f"""
SELECT feature_name, {sr("c")} AS coverage_ratio, {zero("z")} AS non_zero_ratio, u AS unique_count, {zero(d)} AS distinctiveness_score, {zero(e)} AS dispersion_score,
  {zero(f"least(greatest(0.35 * sqrt(c) + 0.25 * z + 0.2 * {d} + 0.2 * {e}, 0), 1)")} AS reliability_score FROM ({facts})
"""


@query("feature_reliability", f"WITH {_LINES} {_reliability_sql()}")
def feature_reliability(t):
    return profiles.reliability_table(lines(t), _ALL)


def _quality_sql() -> str:
    facts = _union([f"SELECT '{f}' AS f, count(v) AS n, count(*) AS rows, avg(CASE WHEN v = 0 THEN 0.0 ELSE 1.0 END)::DOUBLE AS z, count(DISTINCT v) AS u, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi FROM (SELECT nullif({f}, -1) AS v FROM l)" for f in _ALL])
    long = _union([f"SELECT '{f}' AS f, nullif({f}, -1) AS v FROM l" for f in _ALL])
    return f"""
WITH {_LINES}, facts AS ({facts}), b AS (SELECT f, n, coalesce(least(floor((v - lo) / nullif(hi - lo, 0) * k), k - 1), 0) AS bin FROM ({long}) JOIN (SELECT *, least(12, greatest(3, floor(sqrt(u)))) AS k FROM facts) USING (f) WHERE v IS NOT NULL),
h AS (SELECT f, bin, count(*) AS c, any_value(n) AS n FROM b GROUP BY f, bin), e AS (SELECT f, CASE WHEN any_value(n) >= 3 AND count(*) > 1 THEN -sum(c / n::DOUBLE * ln(c / n::DOUBLE)) / ln(count(*)) ELSE 0 END AS e FROM h GROUP BY f),
q AS (SELECT facts.*, coalesce(e, 0) AS e FROM facts LEFT JOIN e USING (f))
SELECT f AS feature_name, {sr("n / rows::DOUBLE")} AS coverage_ratio, u AS unique_count, {sr("CASE WHEN u > 1 THEN e ELSE 0 END")} AS entropy_score, {sr("CASE WHEN u > 1 THEN s ELSE 0 END")} AS variance_score,
  {sr("CASE WHEN u > 1 THEN n / rows::DOUBLE * z * e * sqrt(u / greatest(n, 1)::DOUBLE) * ln(1 + greatest(s, 0)) ELSE 0 END")} AS quality_score FROM q
"""


@query("feature_quality", _quality_sql())
def feature_quality(t):
    return profiles.quality_table(lines(t), _ALL)


_CONFIG = {"attack": [("price", 0.5), ("quantity", 0.3), ("discount", 0.2)], "defence": [("discount", 0.4), ("tax", 0.4), ("constant", 0.2)]}


def _audit_sql() -> str:
    rows = []
    for dim, parts in _CONFIG.items():
        eff = {f: f"({w}::DOUBLE * (SELECT reliability_score FROM rel WHERE feature_name = '{f}'))" for f, w in parts}
        total = " + ".join(eff.values())
        present = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN {e} ELSE 0 END" for f, e in eff.items())
        for f, w in parts:
            rows.append(
                f"SELECT '{dim}' AS dimension, '{f}' AS feature_name, {w}::DOUBLE AS base_weight, {sr(f'(SELECT reliability_score FROM rel WHERE feature_name = {chr(39)}{f}{chr(39)})')} AS reliability_score, {sr(eff[f])} AS global_effective_weight, {sr(f'{eff[f]} / ({total})')} AS global_normalized_weight,"
                f" (SELECT count({f}) FROM l) AS row_usable_count, {sr(f'CASE WHEN {eff[f]} > 0 THEN (SELECT avg(CASE WHEN {f} IS NOT NULL THEN {eff[f]} / nullif({present}, 0) END) FROM l) ELSE 0 END')} AS row_avg_normalized_weight_when_usable"
            )
    return f"WITH {_LINES}, rel AS MATERIALIZED ({_reliability_sql()}) {_union(rows)}"


@query("dimension_weight_audit", _audit_sql())
def dimension_weight_audit(t):
    li = lines(t)
    return profiles.weight_audit(li, _CONFIG, profiles.reliability_table(li, _ALL))


def _filled(cols) -> str:
    return "((" + " + ".join(f"CASE WHEN coalesce({c} <> 0, FALSE) THEN 1.0::DOUBLE ELSE 0 END" for c in cols) + f") / {len(cols)} * 100)"


@query("data_quality_score", f"WITH {_LINES} SELECT l_orderkey, l_linenumber, {sr('CASE WHEN sparse > 2 THEN 0.75 * ' + _filled(['discount', 'tax', 'price']) + ' + 0.25 * ' + _filled(['quantity', 'discount']) + ' ELSE ' + _filled(['discount', 'tax', 'price']) + ' END')} AS data_quality FROM l")
def data_quality_score(t):
    return lines(t).select("l_orderkey", "l_linenumber", r6(profiles.data_quality(["discount", "tax", "price"], ["quantity", "discount"], F.col("sparse") > 2)).alias("data_quality"))


@query(
    "model_quality",
    f"""
WITH g AS (SELECT l_orderkey, l_extendedprice AS y1, avg(l_extendedprice) OVER (PARTITION BY l_quantity) AS p1, l_discount AS y2, avg(l_discount) OVER (PARTITION BY l_returnflag) AS p2 FROM lineitem),
m AS (SELECT 'price' AS dimension, avg(abs(y1 - p1)) AS mae, avg((y1 - p1) * (y1 - p1)) AS mse, sum((y1 - p1) * (y1 - p1)) AS res, var_pop(y1) * count(*) AS tot FROM g
  UNION ALL SELECT 'discount', avg(abs(y2 - p2)), avg((y2 - p2) * (y2 - p2)), sum((y2 - p2) * (y2 - p2)), var_pop(y2) * count(*) FROM g),
a AS (SELECT * FROM m UNION ALL SELECT 'overall', avg(mae), avg(mse), sum(res), sum(tot) FROM m)
SELECT dimension, {sr("mae")} AS mae, {sr("mse", 4)} AS mse, {sr("sqrt(mse)")} AS rmse, {sr("1 - res / nullif(tot, 0)")} AS r2 FROM a
""",
)
def model_quality(t):
    from plumbline.operators.stats import with_stats

    li = t("lineitem")
    g = with_stats(with_stats(li, ["l_quantity"], {"p1": F.avg("l_extendedprice")}), ["l_returnflag"], {"p2": F.avg("l_discount")})
    out = profiles.regression_metrics(g, {"price": ("l_extendedprice", "p1"), "discount": ("l_discount", "p2")}, digits=9)
    return rounded(rounded(out, "mae", "rmse", "r2"), "mse", digits=4)


@query(
    "dimension_weights",
    f"""
WITH m(dimension, r2) AS (SELECT n_name, (n_nationkey - 5) / 20.0::DOUBLE FROM nation), r AS (SELECT dimension, r2, CASE WHEN r2 < 0.1 THEN 0 ELSE greatest(r2, 0.05) END AS raw FROM m)
SELECT dimension, {sr("CASE WHEN (SELECT avg(raw) FROM r) > 0 THEN raw / (SELECT avg(raw) FROM r) ELSE 1 END")} AS weight, r2 >= 0.1 AS active FROM r
""",
)
def dimension_weights(t):
    n = t("nation").select(F.col("n_name").alias("dimension"), ((F.col("n_nationkey") - 5) / 20.0).alias("r2"))
    names = [r[0] for r in n.select("dimension").collect()]
    return rounded(profiles.dimension_weights(n, names), "weight")


@query("value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 3")
def value_counts(t):
    return profiles.value_counts(t("orders"), "o_orderpriority", 3)


@query("table_counts", "SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'customer', (SELECT count(*) FROM customer) UNION ALL SELECT 'absent', NULL")
def table_counts(t):
    return profiles.table_counts({"orders": t("orders"), "customer": t("customer"), "absent": None})


@query("feature_audit", "WITH " + _LINES + ", f AS (" + _union([f"SELECT '{f}' AS feature_name, count({f}) AS n, count(DISTINCT {f}) AS u FROM l" for f in _ALL]) + ") SELECT feature_name, CASE WHEN feature_name <> 'tax' AND n > 0 AND u > 1 THEN 1 ELSE 0 END AS selected, n AS usable_count, u AS unique_count, CASE WHEN feature_name = 'tax' THEN 'manual_required_non_style_or_leakage_exclusion' WHEN u < 2 THEN 'non_numeric_or_constant' ELSE 'numeric_variable' END AS reason FROM f")
def feature_audit(t):
    return profiles.feature_audit(lines(t), _ALL, ["tax"])


_D = ["f0", "f1", "f2", "f3"]


def _summaries(suffix: str, dims: list[str]) -> None:
    """Clusters of labels by the first ``len(dims)`` components."""

    @query(
        f"cluster_summary{suffix}",
        f"""
WITH c AS (SELECT label, count(*) AS team_count, {", ".join(f"avg(embedding[{i + 1}]::DOUBLE) * 100 AS f{i}" for i in range(len(dims)))} FROM embeddings GROUP BY label),
o AS (SELECT *, list_sort([{", ".join(f"{{'k': -f{i}, 'i': {i}, 'n': 'f{i}', 'v': f{i}}}" for i in range(len(dims)))}]) AS o FROM c)
SELECT label, team_count, array_to_string(list_transform(o[:3], lambda e: 'high ' || e.n), ' / ') || ' | ' || array_to_string(list_transform(o[-2:], lambda e: 'low ' || e.n), ' / ') AS cluster_label,
  array_to_string(list_transform(o[:3], lambda e: e.n || '=' || printf('%.1f', e.v)), '; ') AS top_dimensions, array_to_string(list_transform(o[-2:], lambda e: e.n || '=' || printf('%.1f', e.v)), '; ') AS low_dimensions, {", ".join(f"{sr(f'f{i}')} AS avg_f{i}" for i in range(len(dims)))} FROM o
""",
    )
    def cluster_summary(t):
        e = t("embeddings").select("label", *[(F.col("embedding")[i].cast("double") * 100).alias(d) for i, d in enumerate(dims)])
        out = profiles.cluster_summary(e.withColumnRenamed("label", "cluster"), "cluster", dims)
        means = e.groupBy("label").agg(*[r6(F.avg(d)).alias(f"avg_{d}") for d in dims])
        out = out.drop(*[f"avg_{d}" for d in dims]).withColumnRenamed("label", "cluster_label")
        return out.join(means, F.col("cluster").eqNullSafe(F.col("label"))).drop("cluster")


_summaries("", _D)
_summaries("_whole", [f"f{i}" for i in range(64)])


@query("overlap", "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) < 1996), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) >= 1996) SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (o_custkey)) AS n_both")
def overlap(t):
    o = t("orders")
    return matching.overlap(o.where(F.year("o_orderdate") < 1996), o.where(F.year("o_orderdate") >= 1996), ["o_custkey"])


@query("dedupe_best", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedupe_best(t):
    return matching.dedupe_best(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), ["o_custkey", "o_orderstatus"], "o_totalprice", "o_orderkey")


@query("top_ids", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY max(o_totalprice) DESC, o_custkey LIMIT 40")
def top_ids(t):
    return matching.top_ids(t("orders"), "o_custkey", "o_totalprice", 40)


@query("sample_subset", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY max(o_totalprice) DESC, o_custkey LIMIT 40)")
def sample_subset(t):
    ids = matching.top_ids(t("orders"), "o_custkey", "o_totalprice", 40)
    return matching.subset(t("customer"), "c_custkey", ids).select("c_custkey", "c_name")


@query(
    "blended_dimension",
    f"""
WITH {_LINES}, p AS (SELECT l_orderkey, l_linenumber, discount, quantity * 2 AS nq, price / 1000 AS np, coalesce(discount * 1000, 50) AS nd FROM l)
SELECT l_orderkey, l_linenumber, {sr("least(greatest(0.6 * least(greatest((np * 0.5 + nq * 0.3 + nd * 0.2) / 1.0, 0), 100) + 0.4 * least(greatest((np * 0.45 + nq * 0.24 + CASE WHEN discount IS NOT NULL THEN nd * 0.1 ELSE 0 END) / (0.45 + 0.24 + CASE WHEN discount IS NOT NULL THEN 0.1 ELSE 0 END), 0), 100), 0), 100)")} AS score FROM p
""",
)
def blended_dimension(t):
    li = lines(t)
    norm = {"price": F.col("price") / 1000, "quantity": F.col("quantity") * 2, "discount": F.coalesce(F.col("discount") * 1000, F.lit(50.0))}
    rel = {"price": 0.9, "quantity": 0.8, "discount": 0.5}
    score = x.blended_mean(norm, {f: f for f in norm}, rel, _CONFIG["attack"], 0.4)
    return li.select("l_orderkey", "l_linenumber", r6(score).alias("score"))
