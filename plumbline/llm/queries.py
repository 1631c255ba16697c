"""The queries of the training-data operators, with DuckDB SQL where SQL can express them.

Each ``opN_`` query is thin: it applies its operator to a whole table and derives digest columns from what it gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, jaccard, langid, mixing, neardup_vectors, periodic_runs, quality, secrets, sharding, substrings, token_files, vector_codes, warc
from plumbline.llm.common import WORD
from plumbline.sources.scratch import new_path, remove


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_remainder(record: str = "doc_id", parts: int = 4) -> Column:
    return F.pmod(F.crc32(F.col(record).cast("string").cast("binary")), F.lit(parts))


def training_rows(docs: DataFrame) -> DataFrame:
    """``lang``, ``text`` of the documents from which languages are learned: all but the held-out remainder."""
    return docs.where(crc32_remainder() != 2).select("lang", "text")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text").cast("string")
    facts = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("text_group"))
    placed = sharding.shard(facts, "size", "text_group", "doc_id", 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(training_rows(docs))
    named = langid.identify(spark, docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(crc32_remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.STATISTICS, "base_failed", "kept")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path)
    found = token_files.layout(token_files.read(spark, path))  # reads the files once, now
    remove(path)
    return found


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.shingle_join(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = [r.kind for r in secrets.RULES if r.base]
    return found.select("doc_id", *map(count, base), F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, in a tenth of them (by the checksum of the id) with a repeated unit of words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    n = F.size("w")
    placed = chosen.where("size(w) > 0").withColumn("a", (F.col("g") % n).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), n - F.col("a") - 1), lambda i: F.element_at("w", F.col("a") + i % F.col("p") + 1))
    planted = placed.select("doc_id", F.array_join(F.concat(F.slice("w", 1, F.col("a")), tail), " ").alias("text"))
    return chosen.where("coalesce(size(w), 0) <= 0").select("doc_id", "text").unionByName(planted)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    every = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    facts = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), digest(every).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    length = -F.col("top.less")
    return facts.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"), F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.resolve(warc.read(spark, path))  # reads the archives once, now
    remove(path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_language": op2_language,
    "op3_mixing": op3_mixing,
    "op4_embeddings": op4_embeddings,
    "op5_quality": op5_quality,
    "op6_token_files": op6_token_files,
    "op7_jaccard": op7_jaccard,
    "op8_bpe": op8_bpe,
    "op9_secrets": op9_secrets,
    "op10_substrings": op10_substrings,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_warc": op13_warc,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _components(links: str, nodes: str) -> str:
    """CTEs ``reach`` over ``links`` (a, b in both directions) from each of ``nodes`` (id)."""
    return f"""reach(id, r) AS (SELECT id, id FROM {nodes} UNION SELECT reach.id, l.b FROM reach JOIN {links} l ON l.a = reach.r)"""


_OP4 = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.n <> q.n AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
nodes AS (SELECT DISTINCT a AS id FROM links), {_components("links", "nodes")},
low AS (SELECT id, min(r) AS c FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(low.c, vec_id) AS component_id, coalesce(low.c, vec_id) = vec_id AS kept
FROM v LEFT JOIN low ON low.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

_OP7 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM d),
classes AS MATERIALIZED (SELECT min(doc_id) AS c, len(s) AS n, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
g AS MATERIALIZED (SELECT c, n, unnest(s) AS g FROM classes),
o AS (SELECT p.c AS a, q.c AS b, count(*) AS o, any_value(p.n) AS na, any_value(q.n) AS nb FROM g p JOIN g q ON p.g = q.g AND p.c < q.c GROUP BY p.c, q.c),
pairs AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * o >= 80 * (na + nb - o)),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
nodes AS (SELECT c AS id FROM classes), {_components("links", "nodes")},
low AS (SELECT id, min(r) AS low FROM reach GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.c AS class_id, coalesce(low.low, s.doc_id) AS component_id
FROM s LEFT JOIN classes c ON c.s = list_sort(s.s) LEFT JOIN low ON low.id = c.c
"""


def _op9() -> str:
    # RE2 in DuckDB and Java agree on these patterns: ASCII classes, leftmost matches, greedy repeats
    cells = []
    for n, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        cells.append(
            f"SELECT k, {n} AS kind, unnest(list_transform(string_split_regex(t, '{p}')[:-2], lambda x: length(x))) AS gap, "
            f"unnest(list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x))) AS size, unnest(list_transform(regexp_extract_all(t, '{p}', {r.group}), lambda x: length(x))) AS kept, "
            f"generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i FROM d WHERE regexp_matches(t, '{p}')"
        )
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"
    least = "[" + ", ".join(str(r.least) for r in secrets.RULES) + "]"
    base = [n for n, r in enumerate(secrets.RULES) if r.base]
    count = ", ".join(f"count(*) FILTER (kind = {n}) AS n{n}" for n in base)
    names = ", ".join(f"coalesce(n{n}, 0)::BIGINT AS n_{secrets.RULES[n].kind}" for n in base)
    span = f"{kinds}[kind + 1] || ':' || start || ':' || fin"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(cells)}),
p AS (SELECT k, kind, size, kept, sum(gap + size) OVER (PARTITION BY k, kind ORDER BY i) AS fin FROM m),
f AS (SELECT k, kind, (fin - size)::BIGINT AS start, fin::BIGINT AS fin FROM p WHERE kept >= {least}[kind + 1]),
s AS (SELECT k, {count}, string_agg({span}, ',' ORDER BY start, kind) AS spans, string_agg({span}, ',' ORDER BY start, kind) FILTER (kind IN ({", ".join(map(str, base))})) AS base FROM f GROUP BY k)
SELECT doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (k)
"""


_OP10 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
h AS MATERIALIZED (SELECT doc_id, i, md5_number(g) AS g FROM x),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS later FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS place FROM f WHERE later),
cut AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(cut.places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN cut.places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(cut.places, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""



def _op11() -> str:
    near = lambda n: f"""a{n} AS MATERIALIZED (SELECT k, p, x, m[2] AS e, m[1] AS error FROM (SELECT k, p, any_value(x) AS x, min([d, e]) AS m FROM (
  SELECT v.k, v.p, v.x, c.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v JOIN c{n} c ON c.p = v.p) GROUP BY k, p))"""  # noqa: E731
    moved = lambda n: f"""s{n} AS (SELECT p, e, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY p, e, i),
c{n + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{n} GROUP BY p, e) m USING (p, e))"""  # noqa: E731
    return f"""
WITH u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS MATERIALIZED (SELECT k, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS x FROM (SELECT k, x, unnest(range(16)) AS p FROM u)),
c0 AS MATERIALIZED (SELECT p, k - 1 AS e, x FROM v WHERE k <= 64),
{near(0)}, {moved(0)}, {near(1)}, {moved(1)}, {near(2)},
t AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(error)::BIGINT AS error FROM a2 GROUP BY k),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM u JOIN t USING (k), h
"""


_OP12 = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, crc),
p AS (SELECT k, doc_id, w, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM o),
d AS MATERIALIZED (SELECT k, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (len(w) - a) // parts) + 1] END) END AS w FROM p),
x AS MATERIALIZED (SELECT k, n, i, hash(s) AS s FROM (SELECT k, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS s FROM d WHERE len(w) >= 6)),
e AS (SELECT y.k, y.i, z.i - y.i AS q FROM x y JOIN x z ON z.k = y.k AND z.s = y.s AND z.i > y.i AND 4 * (z.i - y.i) <= y.n),
g AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS g FROM e),
l AS MATERIALIZED (SELECT k, q, min(i) AS a, max(i) + 1 + q AS b FROM g GROUP BY k, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT k, q, a, b FROM l WHERE NOT EXISTS (SELECT 1 FROM l m WHERE m.k = l.k AND m.q < l.q AND l.q % m.q = 0 AND m.a <= l.a AND m.b >= l.b)),
f AS (SELECT k, count(*) AS n, min([a - b, a, q]) AS top, string_agg(a || ',' || (b - a) || ',' || q || chr(10), '' ORDER BY a, q) AS lines FROM r GROUP BY k),
gone AS (SELECT k, list(place) AS places FROM (SELECT DISTINCT k, unnest(range(a + q, b)) AS place FROM r) GROUP BY k)
SELECT doc_id, coalesce(f.n, 0)::BIGINT AS n_runs, top[2]::BIGINT AS start, -top[1]::BIGINT AS length, top[3]::BIGINT AS period, (1000 * -top[1] // top[3])::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i - 1)) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN f USING (k) LEFT JOIN gone USING (k)
"""

_OP13 = """
WITH p AS MATERIALIZED (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS low FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN low IS NOT NULL AND page_id IS DISTINCT FROM low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
FROM p LEFT JOIN f USING (h)
"""

SQL: dict[str, str] = {"op4_embeddings": _OP4, "op7_jaccard": _OP7, "op9_secrets": _op9(), "op10_substrings": _OP10, "op11_vector_codes": _op11(), "op12_periodic_runs": _OP12, "op13_warc": _OP13}
