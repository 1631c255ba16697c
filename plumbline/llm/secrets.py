"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must contain.  The index
holds, for each such trigram, the texts that have it; postings are intersected by text; the texts that satisfy a
rule's query are verified with the regular expression itself.  A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import named, spare

#: A query: any of these sets of trigrams, all of a set; one empty set asks for nothing.
Query = frozenset
ANYTHING: Query = frozenset([frozenset()])
_RUNS = 64  # a run of literals is followed while it has so many spellings at most


@dataclass(frozen=True)
class Rule:
    """``kind`` names the spans of ``pattern`` (Java and RE2 alike); group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


def either_case(word: str) -> str:
    """A pattern for ``word`` with ASCII letters of either case and nothing that merely folds to them."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in word)


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
#: The base kinds in their order, then further kinds in public formats.
RULES = [
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # equal to runs of [0-9a-f]+ with 24 characters or more
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]


def either(*queries: Query) -> Query:
    sets = frozenset().union(*queries)
    return frozenset(s for s in sets if not any(t < s for t in sets))


def both(a: Query, b: Query) -> Query:
    return either(frozenset(x | y for x in a for y in b))


def _of_strings(strings: set[str]) -> Query:
    return either(*[frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _walk(items, runs: set[str], query: Query) -> tuple[set[str], Query, bool]:
    """What follows ``runs`` (spellings of the literal text so far) and ``query`` (asked before them), and whether the
    runs spell all of ``items``; where they don't, no literal may be joined to them on either side."""
    whole = True
    for op, arg in items:
        name, spelt = str(op), None
        if name == "LITERAL":
            spelt = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            spelt = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            inner, asked, exact = _walk(arg[3], {""}, ANYTHING)
            if exact:
                spelt = inner
            else:
                query = both(query, both(asked, _of_strings(inner)))
        elif name == "BRANCH":
            ways = [_walk(x, {""}, ANYTHING) for x in arg[1]]
            if all(exact for *_, exact in ways):
                spelt = set().union(*[s for s, *_ in ways])
            else:
                query = both(query, either(*[both(q, _of_strings(s)) for s, q, _ in ways]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner_items = arg
            inner, asked, exact = _walk(inner_items, {""}, ANYTHING)
            if (low, high) == (0, 1) and exact:
                spelt = inner | {""}
            elif low:
                query = both(query, both(asked, _of_strings(inner)))
        elif name == "AT":
            continue
        if spelt is None or len(runs) * len(spelt) > _RUNS:
            query, runs = both(query, _of_strings(runs)), {""}  # the run ends here
            if spelt is not None:
                query = both(query, _of_strings(spelt))
            spelt, whole = {""}, False
        runs = {a + b for a in runs for b in spelt}
    return runs, query, whole


def trigram_query(pattern: str, most: int = 6) -> Query:
    """Sets of lower-case trigrams; a text that matches ``pattern`` has, lower-cased, all of at least one set.

    Long sets are thinned to ``most`` trigrams: fewer are asked for, so nothing is lost.
    """
    runs, query, _ = _walk(re._parser.parse(pattern), {""}, ANYTHING)
    query = both(query, _of_strings(runs))
    thin = lambda s: frozenset(sorted(s)[:: -(-len(s) // most)]) if s else s
    return either(*[frozenset([thin(s)]) for s in query])


def build_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``gram``, ``k1``, ``k2``, ``rec``: the texts that have each trigram, copies once with their smallest record."""
    low = texts.select("k1", "k2", "rec", F.lower("t").alias("low"))
    have = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams]))
    return low.select("k1", "k2", "rec", F.explode(have).alias("gram")).groupBy("gram", "k1", "k2").agg(F.min("rec").alias("rec"))


def intersect(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Texts with ``kinds``, the rules whose queries their postings satisfy."""
    grams = index.groupBy("k1", "k2").agg(F.min("rec").alias("rec"), F.collect_set("gram").alias("grams"))  # a text's set is no larger than the rules' trigrams

    def holds(query: Query) -> Column:
        out = F.lit(False)
        for s in sorted(query, key=sorted):
            every = F.lit(True)
            for g in sorted(s):
                every = every & F.array_contains("grams", g)
            out = out | every
        return out

    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return grams.select("k1", "k2", "rec", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _matches(texts: DataFrame, rules: list[Rule], wanted: Column | None) -> DataFrame:
    """One row a match: its text's keys, rule number, place among the rule's matches, and lengths."""

    def cells(number: int, rule: Rule) -> Column:
        # what lies between matches and the matches themselves, in turn; a match is never empty
        gaps, hits = F.split("t", rule.pattern, -1), F.regexp_extract_all("t", F.lit(rule.pattern), F.lit(0))
        groups = hits if rule.group == 0 else F.regexp_extract_all("t", F.lit(rule.pattern), F.lit(rule.group))
        zipped = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(hits)), lambda g: F.length(g)).alias("gap"), F.transform(hits, lambda h: F.length(h)).alias("size"), F.transform(groups, lambda g: F.length(g)).alias("kept"))
        found = F.col("t").rlike(rule.pattern)
        if wanted is not None:
            found = F.array_contains(wanted, rule.kind) & found
        return F.when(found, F.transform(zipped, lambda z, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), z["gap"].alias("gap"), z["size"].alias("size"), z["kept"].alias("kept"))))

    every = F.flatten(F.array_compact(F.array(*[cells(n, r) for n, r in rules])))
    return texts.select("k1", "k2", F.explode(every).alias("m")).select("k1", "k2", "m.*")


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", record: str = "doc_id") -> DataFrame:
    """Add ``secrets``, an array of structs ``kind``, ``start``, ``end`` (code points, end exclusive), to ``docs``.

    Spans come by start, then in the order of the rules; leftmost matches of a rule don't overlap, and matches whose
    group is too short are dropped after that.  A null or empty text has none.  Equal texts are indexed and verified
    once, however many rows have them; equal ids don't matter, nor do ties.  A very long text is searched whole.  A column
    ``secrets`` is replaced, columns of any other names pass through.  Texts are known by 96 bits of hash.  An empty
    table gives no rows.
    """
    rules = RULES if rules is None else rules
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [(n, r) for n, r in enumerate(rules) if queries[r.kind] != ANYTHING]
    scanned = [(n, r) for n, r in enumerate(rules) if queries[r.kind] == ANYTHING]
    docs = docs.select(*named([c for c in docs.columns if c.lower() != "secrets"]))
    t = F.col(text).cast("string")
    keys = {"k1": F.xxhash64(t), "k2": F.hash(t)}
    rec = F.coalesce(F.col(record).cast("long"), F.xxhash64(t))
    texts = docs.select(*[v.alias(k) for k, v in keys.items()], rec.alias("rec"), t.alias("t")).where(F.length("t") > 0)
    grams = sorted({g for q in queries.values() for s in q for g in s})
    found = []
    if indexed:
        index = build_index(texts, grams)
        candidates = intersect(index, {r.kind: queries[r.kind] for _, r in indexed})
        verified = texts.join(candidates, ["k1", "k2", "rec"])
        found.append(_matches(verified, indexed, F.col("kinds")))
    if scanned:
        found.append(_matches(texts, scanned, None))
    matches = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    # copies of a text found the same; running lengths turn matches into places
    once = matches.groupBy("k1", "k2", "kind", "i").agg(*[F.max(c).alias(c) for c in ("gap", "size", "kept")])
    upto = Window.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = once.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind") + 1)
    placed = placed.where(F.col("kept") >= least).select("k1", "k2", F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end").alias("s"))
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = placed.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("s")).alias("s"))
    spans_named = F.transform("s", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    one, two = spare(docs.columns, "k1"), spare(docs.columns, "k2")
    spans = spans.select(F.col("k1").alias(one), F.col("k2").alias(two), spans_named.alias("secrets"))
    joined = docs.select("*", keys["k1"].alias(one), keys["k2"].alias(two)).join(spans, [one, two], "left")  # reads no text unless asked to
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return joined.select(*named(docs.columns), F.coalesce("secrets", none).alias("secrets"))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` (from :func:`find_secrets`) with every span of ``text`` replaced by its kind in brackets, without ``secrets``.

    Spans that overlap become one mask, named by the first.
    """
    t = F.col(text)

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substr(t, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    masked = F.aggregate("secrets", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), step, lambda a: F.concat(a["out"], F.substr(t, a["at"] + 1)))
    return found.withColumn(text, F.when(F.size("secrets") > 0, masked).otherwise(t)).drop("secrets")
