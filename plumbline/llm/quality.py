"""Quality rules: a decision list learned by sequential covering, in DataFrame functions only.

Document statistics are computed once.  Over the labelled documents, conjunctions of thresholds are grown literal by
literal on one part, pruned on the other, and the documents they cover are taken off before the next rule grows.
Every step is one aggregation of counts; the list becomes one CASE WHEN expression over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import named, scratch

_SPACES = " \t\n\x0b\x0c\r"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bar_share", "bang_share", "digit_share", "line_share", "distinct_share", "end_share"]


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(self.feature) > self.bound if self.above else F.col(self.feature) <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound!r}D"


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    keep: bool

    def column(self) -> Column:
        out = F.lit(True)
        for x in self.literals:
            out = out & x.column()
        return out


def to_sql(rules: list[Rule], default: bool) -> str:
    """The list as one ordered Spark SQL conditional expression."""
    cases = " ".join(f"WHEN {' AND '.join(map(str, r.literals))} THEN {str(r.keep).lower()}" for r in rules)
    return f"CASE {cases} ELSE {str(default).lower()} END" if rules else str(default).lower()


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``STATISTICS`` and the ratios of ``FEATURES``; same-named columns are replaced.

    A null or empty text has no words and zeros throughout.  Work is per row and linear (n log n for repeats) in the
    text's length, so long texts need no more than an array of their words.  Repeated rows get equal statistics each, an
    empty table gives no rows, columns of any other names pass through.
    """
    own = {*STATISTICS, *FEATURES}
    kept = [c for c in docs.columns if c.lower() not in own]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    count = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    d = docs.select(F.struct(*named(kept)).alias("row"), t.alias("_t"))  # all that isn't ours is in row: names can't clash
    d = d.select(
        "row",
        F.transform(F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("_w"),
        F.length(F.translate("_t", _SPACES, "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").cast("long").alias("n_symbols"),
        lines.alias("_l"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_upper"),
        count("|").alias("_bars"),
        count("!?").alias("_bangs"),
        count("0123456789").alias("_digits"),
        count(".").alias("_ends"),
    )
    d = d.withColumns({"n_words": F.size("_w").cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "_kinds": F.size(F.array_distinct("_w"))})
    window = "transform(slice(_w, 1, greatest(size(_w) - 4, 0)), (x, i) -> struct(xxhash64(x, get(_w, i + 1), get(_w, i + 2), get(_w, i + 3), get(_w, i + 4)) as h, i as i))"
    d = d.withColumn("_s", F.expr(f"sort_array({window})"))
    same = "get(_s, {}).h <=> x.h"
    d = d.withColumn("_r", F.expr(f"sort_array(transform(filter(_s, (x, i) -> ({same.format('i - 1')}) or ({same.format('i + 1')})), x -> x.i))"))
    d = d.withColumn("n_repeat_words", F.expr("aggregate(transform(_r, (x, i) -> least(5, coalesce(get(_r, i + 1), x + 5) - x)), 0L, (a, x) -> a + x)"))
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    ratios = {
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("_l"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("_upper") / chars,
        "bar_share": F.col("_bars") / chars,
        "bang_share": F.col("_bangs") / chars,
        "digit_share": F.col("_digits") / chars,
        "line_share": F.size("_l") / words,
        "distinct_share": F.col("_kinds") / words,
        "end_share": F.col("_ends") / words,
    }
    return d.withColumns(ratios).select("row.*", *STATISTICS, *[x for x in FEATURES if x not in STATISTICS])


def learn(labelled: DataFrame, target: str = "target", bounds: int = 12, max_literals: int = 3, max_rules: int = 6, least_cover: int = 8, least_precision: float = 0.8) -> tuple[list[Rule], bool]:
    """Rules and default verdict from rows with ``FEATURES`` and a boolean ``target`` (null: not used).

    Rules single out the rarer verdict; the default is the other.  Two thirds of rows (by a hash of their features)
    grow a rule, by FOIL's gain; the rest prunes its last literals while that doesn't lower its precision there.  A
    rule must cover ``least_cover`` growing rows with ``least_precision`` in all, else learning ends.  Candidate
    thresholds are ``bounds`` quantiles of each feature within both verdicts.  Without rows the default is to keep.
    """
    rows = labelled.where(F.col(target).isNotNull()).select(*[F.col(x).cast("double").alias(x) for x in FEATURES], F.col(target).alias("y"))
    rows = scratch(rows.withColumn("grow", F.pmod(F.xxhash64(*FEATURES), F.lit(3)) != 0), "labelled")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return [], totals.get(False) is None
    aim = totals[True] < totals[False]
    at = [i / (bounds + 1) for i in range(1, bounds + 1)]
    cuts = rows.groupBy("y").agg(*[F.percentile_approx(x, at, 10_000).alias(x) for x in FEATURES]).collect()
    literals = [Literal(x, above, float(b)) for x in FEATURES for b in sorted({b for r in cuts for b in r[x]}) for above in (True, False)]

    def counts(frame: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
        good = F.col("y") == aim
        got = frame.agg(*[F.count(F.when(t & hit, 1)) for t in tests for hit in (good, ~good)]).first()
        return list(zip(got[::2], got[1::2], strict=True))

    import math

    info = lambda p, n: math.log2(p / (p + n))
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        grow, prune = left.where("grow"), left.where("not grow")
        chosen: list[Literal] = []
        p0, n0 = counts(grow, [F.lit(True)])[0]
        while len(chosen) < max_literals and p0 and n0:
            held = Rule(tuple(chosen), aim).column()
            found = counts(grow, [held & x.column() for x in literals])
            gains = [(p * (info(p, n) - info(p0, n0)), -i) for i, (p, n) in enumerate(found) if p >= least_cover]
            if not gains or max(gains)[0] <= 1e-9:
                break
            i = -max(gains)[1]
            chosen.append(literals[i])
            p0, n0 = found[i]
        if not chosen:
            break
        ways = [tuple(chosen[:k]) for k in range(1, len(chosen) + 1)]
        held = counts(prune, [Rule(w, aim).column() for w in ways])
        worth = lambda c: (c[0] + 1) / (c[0] + c[1] + 2)
        best = max(range(len(ways)), key=lambda k: (worth(held[k]), -k))
        rule = Rule(ways[best], aim)
        p, n = counts(left, [rule.column()])[0]
        if p < least_cover or p / (p + n) < least_precision:
            break
        rules.append(rule)
        left = left.where(~rule.column())
    return rules, not aim


def judge(stats: DataFrame, rules: list[Rule], default: bool) -> DataFrame:
    """Add ``base_failed`` and ``kept``; columns of these names are replaced."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", F.when(failed, False).otherwise(F.expr(to_sql(rules, default))))


def quality(docs: DataFrame, labels: DataFrame, record: str = "doc_id", label: str = "quality", text: str = "text") -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for all documents; the list is learned on those that ``labels`` has.

    ``labels`` has ``record`` and a 0/1 ``label`` (null: not used).  A document labelled more than once counts once
    for each label, repeated rows each; a null id has no label.  Without any label every document that passes the base
    rules is kept.  Columns named as what is added are replaced, all others pass through.  An empty table gives no rows.
    """
    stats = scratch(statistics(docs, text), "statistics")
    known = labels.select(F.col(record).alias("_id"), (F.col(label).cast("int") == 1).alias("target")).where("_id is not null")
    able = stats.where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words").select(F.col(record).alias("_key"), *FEATURES)
    rules, default = learn(able.join(known, F.col("_key") == F.col("_id")))
    return judge(stats, rules, default)
