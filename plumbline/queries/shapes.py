"""Scalar cleaning, rates, categories, names and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import exprs as x
from plumbline.queries.registry import query, r6, sr

_WORDS = "CASE p_partkey % 12 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'gk' WHEN 2 THEN 'FWD' WHEN 3 THEN ' fw ' WHEN 4 THEN 'Striker' WHEN 5 THEN 'Centre-Forward' WHEN 6 THEN 'mid ' WHEN 7 THEN NULL WHEN 8 THEN 'Winger' WHEN 9 THEN 'Left Back' WHEN 10 THEN 'Defender' ELSE 'Defensive Midfield' END"
_SEASONS = "CASE p_partkey % 9 WHEN 0 THEN '2015/2016' WHEN 1 THEN '2015/16' WHEN 2 THEN '2016–2017' WHEN 3 THEN 'Season 2014' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'abc' WHEN 7 THEN '1999-00' ELSE 'none' END"


@query(
    "clean_numbers",
    f"""
WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN '-1' WHEN 2 THEN 'Infinity' WHEN 3 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS t FROM events)
SELECT event_id, try_cast(t AS DOUBLE) IS NULL AS not_number, CASE WHEN isfinite(try_cast(t AS DOUBLE)) AND try_cast(t AS DOUBLE) <> -1 THEN try_cast(t AS DOUBLE) END AS cleaned FROM e
""",
)
def clean_numbers(t):
    m = F.col("event_id") % 5
    text = F.when(m == 0, "x").when(m == 1, "-1").when(m == 2, "Infinity").when(m == 4, F.col("event_id").cast("string"))
    e = t("events").select("event_id", text.alias("t"))
    return e.select("event_id", x.to_number("t").isNull().alias("not_number"), x.clean_number("t", -1).alias("cleaned"))


@query(
    "safe_rates",
    f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, l_quantity AS q, l_discount * CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, {sr("CASE WHEN d > 0 THEN p / d END")} AS rate, {sr("CASE WHEN d > 0 THEN 1 / d END")} AS inverse, {sr("p / nullif(d, 0) * 90")} AS per_90, {sr("q * 90 / CASE WHEN d > 0 THEN d END")} AS minutes_per_goal,
  {sr("coalesce(CASE WHEN d > 0 THEN d END, q)")} AS first_value, {sr("-d")} AS negated FROM l
""",
)
def safe_rates(t):
    d = F.col("l_discount") * F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(1)
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), d.alias("d"), F.when(d > 0, d).alias("positive"))
    return df.select(
        "l_orderkey",
        "l_linenumber",
        r6(x.safe_rate("p", "d")).alias("rate"),
        r6(x.safe_inverse("d")).alias("inverse"),
        r6(x.per_90("p", "d")).alias("per_90"),
        r6(x.minutes_per_goal("q", "d")).alias("minutes_per_goal"),
        r6(x.first_non_null(df.columns, ["absent", "positive", "q"])).alias("first_value"),
        r6(-F.col("d")).alias("negated"),
    )


def _bucket(s: str) -> str:
    t = f"lower(trim({s}))"
    return f"CASE WHEN contains({t}, 'goalkeeper') OR {t} = 'gk' THEN 'GK' WHEN contains({t}, 'defender') OR {t} = 'def' THEN 'DEF' WHEN contains({t}, 'midfielder') OR {t} = 'mid' THEN 'MID' WHEN contains({t}, 'forward') OR contains({t}, 'striker') OR {t} = 'fw' THEN 'FWD' ELSE 'OTHER' END"


@query(
    "position_bucket",
    f"""
WITH p AS (SELECT p_partkey, {_WORDS} AS s FROM part)
SELECT p_partkey, {_bucket("s")} AS bucket, CASE WHEN s = 'Goalkeeper' THEN 'GK' WHEN s IN ('Defender', 'Left Back', 'Right Back') THEN 'DF' WHEN s IN ('Midfielder', 'Defensive Midfield') THEN 'MF' WHEN s = 'Forward' THEN 'FW' END AS role,
  CASE WHEN s IS NULL THEN 'UNK' WHEN regexp_matches(lower(s), 'goalkeeper|keeper|gk') THEN 'GK' WHEN regexp_matches(lower(s), 'forward|attacker|striker|winger|fw|st|cf|lw|rw') THEN 'FW' WHEN regexp_matches(lower(s), 'midfielder|midfield|half|mf|dm|cm|am') THEN 'MF' WHEN regexp_matches(lower(s), 'defender|defence|defense|centre-back|center-back|full-back|back|df') THEN 'DF' ELSE 'UNK' END AS role_group FROM p
""",
)
def position_bucket(t):
    p = t("part").select("p_partkey", F.expr(_WORDS).alias("s"))
    return p.select("p_partkey", x.position_bucket("s").alias("bucket"), x.exact_role("s").alias("role"), x.role_group("s").alias("role_group"))


@query(
    "season_year",
    f"""
WITH p AS (SELECT p_partkey, replace(replace(trim({_SEASONS}), '–', '-'), '—', '-') AS s FROM part), q AS (SELECT p_partkey, CASE WHEN lower(s) NOT IN ('', 'none', 'nan') THEN s END AS s FROM p)
SELECT p_partkey, try_cast(coalesce(nullif(regexp_extract(s, '^(\\d{{4}})\\s*[/-]\\s*\\d{{4}}$', 1), ''), nullif(regexp_extract(s, '^(\\d{{4}})\\s*[/-]\\s*\\d{{2}}$', 1), ''), nullif(regexp_extract(s, '(19\\d{{2}}|20\\d{{2}})', 1), '')) AS INTEGER) AS start_year,
  try_cast(nullif(regexp_extract({_SEASONS}, '(\\d{{4}})', 1), '') AS INTEGER) AS first_year FROM q JOIN part USING (p_partkey)
""",
)
def season_year(t):
    p = t("part").select("p_partkey", F.expr(_SEASONS).alias("s"))
    return p.select("p_partkey", x.season_start("s").alias("start_year"), x.first_year("s").alias("first_year"))


@query(
    "name_key",
    """
WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'A.F.C. ' || c_name || ' & Bar FC' WHEN 1 THEN 'FC Club de' WHEN 2 THEN NULL ELSE 'The ' || c_name END AS s FROM customer)
SELECT c_custkey, array_to_string(list_filter(string_split(trim(regexp_replace(replace(lower(coalesce(s, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('fc', 'cf', 'afc', 'sc', 'ac', 'club', 'de', 'the', '')), ' ') AS name_key FROM c
""",
)
def name_key(t):
    m, n = F.col("c_custkey") % 4, F.col("c_name")
    text = F.when(m == 0, F.concat(F.lit("A.F.C. "), n, F.lit(" & Bar FC"))).when(m == 1, "FC Club de").when(m == 3, F.concat(F.lit("The "), n))
    return t("customer").select("c_custkey", x.name_key(text).alias("name_key"))


def _ppf() -> str:
    # The published coefficients of the approximation.
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]

    def poly(cs, v):
        out = "0.0::DOUBLE"
        for k in cs:
            out = f"({out} * {v} + ({k!r})::DOUBLE)"
        return out

    low, high, r = "sqrt(-2 * ln(p))", "sqrt(-2 * ln(1 - p))", "((p - 0.5) * (p - 0.5))"
    return f"CASE WHEN p < 0.02425 THEN {poly(c, low)} / {poly(d, low)} WHEN p <= 0.97575 THEN {poly(a, r)} * (p - 0.5) / {poly(b, r)} ELSE -{poly(c, high)} / {poly(d, high)} END"


@query("inverse_normal", f"WITH r AS (SELECT c_custkey, (rank() OVER (ORDER BY c_custkey) - 0.5::DOUBLE) / (SELECT count(*) FROM customer) AS p FROM customer) SELECT c_custkey, {sr(_ppf())} AS z FROM r")
def inverse_normal(t):
    from plumbline.operators.stats import percentile_ranks, with_stats

    c = with_stats(percentile_ranks(t("customer"), "c_custkey", "r"), (), {"n": F.count(F.lit(1))})
    return c.select("c_custkey", r6(x.inverse_normal(F.col("r") - 0.5 / F.col("n"))).alias("z"))


_DIMS = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
_SQL_Z = ", ".join(f"(l.{c} - avg_{n}) / sd_{n} AS {n}" for n, c in _DIMS.items())
_SQL_S = ", ".join(f"avg({c}) AS avg_{n}, stddev_pop({c}) AS sd_{n}" for n, c in _DIMS.items())
_SQL_L = "[" + ", ".join(f"{{'k': -abs({n}), 'i': {i}, 'n': '{n}', 'v': {n}}}" for i, n in enumerate(_DIMS)) + "]"
_SQL_F = "[" + ", ".join(f"{{'k': -{n}, 'i': {i}, 'n': '{n}', 'v': {n}}}" for i, n in enumerate(_DIMS)) + "]"


@query(
    "style_signature",
    f"""
WITH s AS (SELECT {_SQL_S} FROM lineitem), z AS (SELECT l_orderkey, l_linenumber, {_SQL_Z} FROM lineitem l, s)
SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_sort({_SQL_L})[:3], lambda e: CASE WHEN e.v >= 0 THEN 'high_' ELSE 'low_' END || e.n), ' + ') AS signature,
  array_to_string(list_transform(list_sort({_SQL_F})[:2], lambda e: e.n || '=' || printf('%.1f', e.v)), '; ') AS strongest FROM z
""",
)
def style_signature(t):
    from plumbline.operators.stats import with_stats

    li = t("lineitem")
    s = with_stats(li, (), {f"avg_{n}": F.avg(c) for n, c in _DIMS.items()} | {f"sd_{n}": F.stddev_pop(c) for n, c in _DIMS.items()})
    z = s.select("l_orderkey", "l_linenumber", *[((F.col(c) - F.col(f"avg_{n}")) / F.col(f"sd_{n}")).alias(n) for n, c in _DIMS.items()])
    return z.select("l_orderkey", "l_linenumber", x.signature({n: n for n in _DIMS}).alias("signature"), x.listed({n: n for n in _DIMS}, 2).alias("strongest"))


_RW = {"A": {"quantity": 0.5, "price": 0.3, "absent": 0.2}, "N": {"price": 0.6, "discount": 0.4}, "R": {"quantity": 0.2, "discount": 0.8}}


def _sql_mean(parts):
    num = " + ".join(f"coalesce({c}, 0) * {w}::DOUBLE" for c, w in parts)
    den = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for c, w in parts)
    return f"(({num}) / nullif({den}, 0))"


_HAVE = lambda ws: [(c, w) for c, w in ws.items() if c in _DIMS]


@query(
    "rating_display",
    f"""
WITH s AS (SELECT {_SQL_S} FROM lineitem), z0 AS (SELECT l_orderkey, l_linenumber, l_returnflag, {_SQL_Z} FROM lineitem l, s), z AS (SELECT l_orderkey, l_linenumber, l_returnflag, quantity, discount, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE price END AS price FROM z0)
SELECT l_orderkey, l_linenumber, {sr("coalesce(CASE l_returnflag " + " ".join(f"WHEN '{k}' THEN {_sql_mean(_HAVE(ws))}" for k, ws in _RW.items()) + f" END, {_sql_mean([('discount', 1.0), ('price', 1.0), ('quantity', 1.0)])})")} AS rating FROM z
""",
)
def rating_display(t):
    from plumbline.operators.stats import with_stats

    s = with_stats(t("lineitem"), (), {f"avg_{n}": F.avg(c) for n, c in _DIMS.items()} | {f"sd_{n}": F.stddev_pop(c) for n, c in _DIMS.items()})
    z = s.select("l_orderkey", "l_linenumber", "l_returnflag", *[((F.col(c) - F.col(f"avg_{n}")) / F.col(f"sd_{n}")).alias(n) for n, c in _DIMS.items()])
    z = z.withColumn("price", F.when(F.col("l_linenumber") % 4 != 0, F.col("price")))
    return z.select("l_orderkey", "l_linenumber", r6(x.rating("l_returnflag", _RW, z.columns)).alias("rating"))


@query(
    "legacy_rating",
    f"""
WITH s AS (SELECT {_SQL_S} FROM lineitem), z AS (SELECT l_orderkey, l_linenumber, {_SQL_Z} FROM lineitem l, s)
SELECT l_orderkey, l_linenumber, {sr("least(greatest(5 + 1.5 * (quantity * 1.0 + price * 0.7 - discount * 0.5 - tax * 0.3) / 2.5, 0), 10)")} AS rating FROM z
""",
)
def legacy_rating(t):
    from plumbline.operators.stats import z_scores

    z = z_scores(t("lineitem"), _DIMS)
    return z.select("l_orderkey", "l_linenumber", r6(x.linear_score([("quantity", 1.0), ("price", 0.7), ("discount", -0.5), ("tax", -0.3)])).alias("rating"))


@query(
    "json_text",
    "SELECT o_orderkey, '[{\"status\":\"' || o_orderstatus || '\",\"key\":' || o_orderkey || '}]' AS doc FROM orders",
)
def json_text(t):
    from plumbline.sources.io import json_columns

    o = t("orders").select("o_orderkey", F.array(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"))).alias("doc"))
    return json_columns(o, ["doc"])
