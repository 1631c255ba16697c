"""Scalar expressions as Column builders; everything runs inside Spark's code generation.

A missing value is NULL throughout: NaN, infinities and text that isn't a number become NULL on entry, and clipping
keeps NULL (``greatest`` alone would turn it into the bound).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Expr = Column | str


def col(x: Expr) -> Column:
    return F.col(x) if isinstance(x, str) else x


# cleaning


def to_number(x: Expr) -> Column:
    """Double, or NULL where the value isn't a number."""
    return col(x).try_cast("double")


def clean_number(x: Expr, missing: float | None = None) -> Column:
    """:func:`to_number` with NaN, infinities and the sentinel ``missing`` as NULL."""
    v = to_number(x)
    bad = F.isnan(v) | (F.abs(v) == F.lit(math.inf))
    if missing is not None:
        bad = bad | (v == F.lit(float(missing)))
    return F.when(~bad, v)


def clip(x: Expr, low: float | None = None, high: float | None = None) -> Column:
    v = out = col(x)
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(v.isNotNull(), out)


def nonzero(x: Expr) -> Column:
    """NULL in place of zero."""
    return F.nullif(col(x), F.lit(0))


def safe_inverse(x: Expr) -> Column:
    return F.when(col(x) > 0, 1.0 / col(x))


def safe_rate(n: Expr, d: Expr) -> Column:
    return F.when(col(d) > 0, col(n) / col(d))


def per_90(total: Expr, minutes: Expr) -> Column:
    return col(total) / nonzero(minutes) * 90.0


def minutes_per_goal(played: Expr, goals: Expr) -> Column:
    return col(played) * 90.0 / F.when(col(goals) > 0, col(goals))


def first_non_null(available: Sequence[str], names: Sequence[str]) -> Column:
    """The first non-null of those ``names`` that are ``available``; NULL if none is."""
    have = [F.col(n) for n in names if n in available]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


# averages and scores


def weighted_mean(parts: Sequence[tuple[Expr, float]]) -> Column:
    """Mean by weight over the parts that aren't NULL; NULL if none is there or the weights sum to zero.

    Where all parts are there, the weights' sum is their exact one, so that a mean on a threshold isn't moved off it.
    """
    total = sum((F.coalesce(col(x), F.lit(0.0)) * w for x, w in parts), F.lit(0.0))
    weight = sum((F.when(col(x).isNotNull(), F.lit(float(w))).otherwise(0.0) for x, w in parts), F.lit(0.0))
    if parts:
        some_missing = sum((col(x).isNull().cast("int") for x, _ in parts), F.lit(0)) > 0
        weight = F.when(some_missing, weight).otherwise(F.lit(math.fsum(w for _, w in parts)))
    return total / nonzero(weight)


def prior_mean(parts: Sequence[tuple[Expr, float]], low: float = 0.0, high: float = 100.0) -> Column:
    """Mean by fixed weights (NULL if any part is), clipped."""
    weight = sum(w for _, w in parts)
    if not parts or weight == 0:
        raise ValueError("a mean needs parts with weight")
    return clip(sum((col(x) * w for x, w in parts), F.lit(0.0)) / weight, low, high)


def adaptive_mean(parts: Sequence[tuple[Expr, Expr, float]], empty: float = 50.0) -> Column:
    """Mean of (normalised, raw, effective weight) parts whose raw value is there; ``empty`` if none is."""
    parts = [p for p in parts if p[2] > 0]
    total = sum((F.when(col(r).isNotNull(), col(n)).otherwise(0.0) * w for n, r, w in parts), F.lit(0.0))
    weight = sum((F.when(col(r).isNotNull(), F.lit(float(w))).otherwise(0.0) for _, r, w in parts), F.lit(0.0))
    return clip(F.when(weight > 0, total / weight).otherwise(F.lit(float(empty))), 0, 100)


def blended_mean(normalised: Mapping[str, Expr], raw: Mapping[str, Expr], reliability: Mapping[str, float], parts: Sequence[tuple[str, float]], alpha: float = 0.0) -> Column:
    """(1 - alpha) of the prior mean and alpha of the reliability-weighted one."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha must be between 0 and 1")
    fixed = prior_mean([(normalised[f], w) for f, w in parts])
    adaptive = adaptive_mean([(normalised[f], raw[f], w * reliability.get(f, 0.0)) for f, w in parts])
    return clip((1.0 - alpha) * fixed + alpha * adaptive, 0, 100)


def soft_clip(z: Expr, limit: float = 4.0) -> Column:
    return limit * F.tanh(col(z) / limit)


def tanh_score(z: Expr, center: float = 5.0, span: float = 4.0, high: float = 10.0) -> Column:
    return clip(center + span * F.tanh(col(z)), 0, high)


def linear_score(parts: Sequence[tuple[Expr, float]], center: float = 5.0, factor: float = 1.5, high: float = 10.0) -> Column:
    """center + factor * (sum of weight * z) / (sum of absolute weights), clipped; a NULL z counts as nothing."""
    weight = sum(abs(w) for _, w in parts)
    if not weight:
        return F.lit(float(center))
    return clip(center + factor * sum((F.coalesce(col(z), F.lit(0.0)) * w for z, w in parts), F.lit(0.0)) / weight, 0, high)


def rating(bucket: Expr, weights: Mapping[str, Mapping[str, float]], available: Sequence[str], drop: Sequence[str] = ()) -> Column:
    """Weighted mean by the weights of a row's bucket; equal weights where that gives nothing."""
    use = lambda ws: [(c, w) for c, w in ws.items() if c in available and c not in drop]
    chosen = F.lit(None).cast("double")
    for name, ws in weights.items():
        if use(ws):
            chosen = F.when(col(bucket) == name, weighted_mean(use(ws))).otherwise(chosen)
    every = sorted({c for ws in weights.values() for c in ws})
    equal = use(dict.fromkeys(every, 1.0))
    return F.coalesce(chosen, weighted_mean(equal)) if equal else chosen


def sample_weight(minutes: Expr, minutes_k: Expr, games: Expr, games_k: Expr, low: float = 0.2, high: float = 2.0) -> Column:
    m, a = F.greatest(F.coalesce(col(minutes), F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(col(games), F.lit(0.0)), F.lit(0.0))
    return clip(low + (high - low) * (m / (m + col(minutes_k))) * F.sqrt(a / (a + col(games_k))), low, high)


# distances


def log_ratio_error(base: Expr, other: Expr) -> Column:
    return F.abs(F.ln(F.when(col(other) > 0, col(other)) / F.when(col(base) > 0, col(base))))


def relative_error(base: Expr, other: Expr) -> Column:
    """Difference over the larger magnitude; NULL if either is, or both are zero."""
    both = F.when(col(base).isNotNull() & col(other).isNotNull(), F.greatest(F.abs(col(base)), F.abs(col(other))))
    return F.abs(col(other) - col(base)) / nonzero(both)


def rmse_distance(pairs: Sequence[tuple[Expr, Expr]], weights: Sequence[Expr | float]) -> Column:
    """Root of the weighted mean of squared differences."""
    ws = [F.lit(float(w)) if isinstance(w, (int, float)) else col(w) for w in weights]
    total = sum((w * (col(a) - col(b)) * (col(a) - col(b)) for (a, b), w in zip(pairs, ws, strict=True)), F.lit(0.0))
    return F.sqrt(total / nonzero(sum(ws, F.lit(0.0))))


def half_life_percent(distance: Expr, half: Expr) -> Column:
    """100 at distance 0, 50 at the half-life."""
    h = F.when(col(half) > 0, col(half)).otherwise(1.0)
    return clip(100.0 * F.exp(F.lit(math.log(0.5)) * (col(distance) / h) * (col(distance) / h)), 0, 100)


def inverse_normal(p: Expr) -> Column:
    """Inverse normal distribution function by a rational approximation in three regions; NULL outside (0, 1)."""
    # The published coefficients of the approximation.
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]

    def poly(cs: list[float], x: Column) -> Column:
        out = F.lit(0.0)
        for k in cs:
            out = out * x + k
        return out

    p = col(p)
    tail = lambda q: poly(c, q) / (poly(d, q) * q + 1.0)
    mid = p - 0.5
    r = mid * mid
    low, high = F.sqrt(-2.0 * F.ln(p)), F.sqrt(-2.0 * F.ln(1.0 - p))
    return F.when((p > 0) & (p < 0.02425), tail(low)).when((p >= 0.02425) & (p <= 0.97575), poly(a, r) * mid / (poly(b, r) * r + 1.0)).when((p > 0.97575) & (p < 1), -tail(high))


# categories and names

#: Words found within, and words equal to, a position that name its bucket, in order of precedence.
BUCKETS = [("GK", ["goalkeeper"], ["gk"]), ("DEF", ["defender"], ["def"]), ("MID", ["midfielder"], ["mid"]), ("FWD", ["forward", "striker"], ["fw"])]
#: Exact positions of the four roles.
ROLES = {"FW": ["Forward"], "MF": ["Midfielder", "Defensive Midfield"], "DF": ["Defender", "Left Back", "Right Back"], "GK": ["Goalkeeper"]}
#: Words within a position that name its role, in order of precedence.
ROLE_WORDS = [
    ("GK", ["goalkeeper", "keeper", "gk"]),
    ("FW", ["forward", "attacker", "striker", "winger", "fw", "st", "cf", "lw", "rw"]),
    ("MF", ["midfielder", "midfield", "half", "mf", "dm", "cm", "am"]),
    ("DF", ["defender", "defence", "defense", "centre-back", "center-back", "full-back", "back", "df"]),
]


def position_bucket(x: Expr, fix_fwd: bool = False) -> Column:
    """GK, DEF, MID, FWD or OTHER; "fwd" itself counts as FWD only with ``fix_fwd``."""
    text = F.lower(F.trim(col(x)))
    out = F.lit("OTHER")
    for name, within, equal in reversed(BUCKETS):
        hit = text.isin(equal + (["fwd"] if fix_fwd and name == "FWD" else []))
        for w in within:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def exact_role(x: Expr) -> Column:
    out = F.lit(None).cast("string")
    for role, positions in ROLES.items():
        out = F.when(col(x).isin(positions), role).otherwise(out)
    return out


def role_group(x: Expr, words: Sequence[tuple[str, Sequence[str]]] = ROLE_WORDS) -> Column:
    """Role by words within the position, by precedence; UNK otherwise."""
    text = F.lower(F.coalesce(col(x).cast("string"), F.lit("")))
    out = F.lit("UNK")
    for role, within in reversed(words):
        out = F.when(text.rlike("|".join(within)), role).otherwise(out)
    return out


def season_start(x: Expr) -> Column:
    """Start year of "2015/2016", "2015/16" or "2015-16" (any dash), else the first 19xx or 20xx in the text."""
    t = F.translate(F.trim(col(x).cast("string")), "–—", "--")
    t = F.when(~F.lower(t).isin("", "none", "nan"), t)
    pick = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    tries = [r"^(\d{4})\s*[/-]\s*\d{4}$", r"^(\d{4})\s*[/-]\s*\d{2}$", r"(19\d{2}|20\d{2})"]
    return F.coalesce(*map(pick, tries)).cast("int")


def first_year(x: Expr) -> Column:
    """The first four digits in a row."""
    return F.nullif(F.regexp_extract(col(x).cast("string"), r"(\d{4})", 1), F.lit("")).cast("int")


#: Words that don't tell teams apart.
STOP_WORDS = ["fc", "cf", "afc", "sc", "ac", "club", "de", "the"]


def name_key(x: Expr) -> Column:
    """Lower-case words of a name without the stop words; "&" is "and", NULL is empty."""
    t = F.replace(F.lower(F.coalesce(col(x).cast("string"), F.lit(""))), F.lit("&"), F.lit(" and "))
    words = F.split(F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(STOP_WORDS) & (w != "")), " ")


def group_key(xs: Sequence[Expr]) -> Column:
    """Values joined by "|"; NULL reads "nan"."""
    return F.concat_ws("|", *[F.coalesce(col(x).cast("string"), F.lit("nan")) for x in xs])


# texts from ranked values


def ranked(values: Mapping[str, Expr], by_size: bool = False, ascending: bool = False) -> Column:
    """Array of structs (k, i, name, v) of the non-null values, largest (or smallest) first; ties in the given order."""
    sign = 1.0 if ascending else -1.0
    items = [F.struct((sign * (F.abs(col(v)) if by_size else col(v))).alias("k"), F.lit(i).alias("i"), F.lit(n).alias("name"), col(v).cast("double").alias("v")) for i, (n, v) in enumerate(values.items())]
    return F.array_sort(F.filter(F.array(*items), lambda s: s["v"].isNotNull()))


def signature(values: Mapping[str, Expr], most: int = 3, prefixes: tuple[str, str] = ("high_", "low_")) -> Column:
    """ "high_a + low_b": the values largest in size, named by their sign."""
    top = F.slice(ranked(values, by_size=True), 1, most)
    return F.array_join(F.transform(top, lambda s: F.concat(F.when(s["v"] >= 0, prefixes[0]).otherwise(prefixes[1]), s["name"])), " + ")


def listed(values: Mapping[str, Expr], most: int, ascending: bool = False, digits: int = 1) -> Column:
    """ "a=1.0; b=2.0": the largest (or smallest) values with their numbers."""
    top = F.slice(ranked(values, ascending=ascending), 1, most)
    return F.array_join(F.transform(top, lambda s: F.format_string(f"%s=%.{digits}f", s["name"], s["v"])), "; ")


def membership(distances: Sequence[Expr], own: Expr, half: Expr) -> Column:
    """exp(-d / half) of the own centre (its 0-based number) over the sum for all centres."""
    e = F.array(*[F.exp(-col(d) / col(half)) for d in distances])
    return F.get(e, col(own).cast("int")) / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
