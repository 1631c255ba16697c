"""Operators that SQL can't express, against plain versions on small tables."""

import collections
import random

import numpy as np
import plain
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import langid, mixing, neardup_vectors, quality, sharding

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DIR}/documents.parquet").to_pylist()


def signed(n):
    return n - 2**64 if n >= 2**63 else n


@pytest.mark.parametrize("hot", [0, 40, 600])
def test_shards(spark, hot):
    """Sizes of many small groups beside one of ``hot`` records, which fits into a shard or doesn't."""
    r = random.Random(hot)
    rows = [(i, f"text {r.randrange(200)} of many") for i in range(400)] + [(1000 + i, "the hot text") for i in range(hot)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", (F.octet_length("text") + 16).cast("long").alias("size"), F.xxhash64("text").alias("g"))
    got = {x["doc_id"]: x for x in sharding.shard(df, "size", "g", "doc_id", 8).collect()}
    want = plain.shards([(signed(xxhash.xxh64(t.encode(), seed=42).intdigest()), i, len(t) + 16) for i, t in rows], 8)
    assert [got[i]["shard"] for i, _ in rows] == want
    fair = sum(len(t) + 16 for _, t in rows) / 8
    sizes = collections.Counter()
    for i, t in rows:
        sizes[got[i]["shard"]] += len(t) + 16
    assert all(abs(sizes[s] - fair) <= 0.1 * fair for s in range(8))
    for s in range(8):
        assert sorted(x["slot"] for x in got.values() if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got.values())))
    cut = {t for t in {t for _, t in rows} if len({got[i]["shard"] for i, u in rows if u == t}) > 1}
    assert cut == ({"the hot text"} if hot == 600 else set())


def test_groups_of_documents_stay_whole(spark, docs):
    from plumbline.llm.queries import op1_sharding

    got = {r["doc_id"]: r["shard"] for r in op1_sharding(spark, DIR).collect()}
    by = collections.defaultdict(set)
    for d in docs:
        by[d["text"]].add(got[d["doc_id"]])
    assert max(map(len, by.values())) == 1


def test_code_lengths(spark, docs):
    train = [(d["lang"], d["text"]) for d in docs[:60] if d["lang"] and d["text"]] + [("zh", "\u4e2d\u6587 \u6587\u5b57"), ("el", "\u03b1\u03b2\u03b3 \u03b1\u03b2")]
    model = langid.train(spark.createDataFrame(train, "lang string, text string"))
    texts = [d["text"][:400] for d in docs[60:80]] + ["\u4e2d\u5b57", "\u03b1\u03b3", "a", "\U0001f600"]
    bits, _ = langid.code_lengths(model, langid._index(model, -1), pa.array(texts, pa.large_string()))
    for t, row in zip(texts, bits):
        want = [plain.code_length([x for name, x in train if name == lang], t) for lang in model.languages]
        assert np.allclose(row, want, rtol=1e-4, atol=1e-3)
    named = langid.identify(spark, spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    assert [r["lang_pred"] for r in named] == [model.languages[b.argmin()] if any(c.isalpha() for c in t) else "und" for t, b in zip(texts, bits)]


def test_languages_of_several_scripts(spark):
    """Held-out accuracy where letters take two and three bytes."""
    r = random.Random(5)
    alphabets = {"el": "\u03b1\u03b2\u03b3\u03b4\u03b5\u03b6", "ru": "\u0430\u0431\u0432\u0433\u0434\u0435", "uk": "\u0430\u0431\u0432\u0433\u0454\u0456", "hi": "\u0915\u0916\u0917\u0918\u0919", "zh": "\u4e2d\u6587\u5b57\u6bcd\u8868"}
    text = lambda a: " ".join("".join(r.choice(a) for _ in range(r.randrange(2, 7))) for _ in range(12))
    rows = [(k, text(a)) for k, a in alphabets.items() for _ in range(40)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    held = [(k, text(a)) for k, a in alphabets.items() for _ in range(20)]
    got = langid.identify(spark, spark.createDataFrame(held, "lang string, text string"), model).collect()
    assert sum(x["lang_pred"] == x["lang"] for x in got) >= 0.98 * len(held)


def test_fair_queue(spark, docs):
    got = {r["doc_id"]: r for r in mixing.mix(spark.read.parquet(f"{DIR}/documents.parquet")).collect()}
    want = plain.fair_queue([(d["doc_id"], d["source"], got[d["doc_id"]]["size"]) for d in docs])
    assert {i: r["copies"] for i, r in got.items()} == {i: want[i] for i in got}
    sizes = collections.Counter()
    for d in docs:
        sizes[d["source"]] += got[d["doc_id"]]["size"]
    target = plain.targets(sizes)
    assert all(abs(got[d["doc_id"]]["target"] - target[d["source"]]) < 1e-6 for d in docs)


def test_fair_queue_of_one_source(spark):
    rows = [(i, None if i % 5 else "b", "w " * (i % 7)) for i in range(300)]
    got = {r["doc_id"]: (r["size"], r["copies"]) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), rows_per_bucket=8).collect()}
    want = plain.fair_queue([(i, s, got[i][0]) for i, s, _ in rows])
    assert {i: c for i, (_, c) in got.items()} == {i: want[i] for i in got}


def test_sequential_covering(spark, docs):
    known = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DIR}/labels.parquet").to_pylist()}
    stats = quality.statistics(spark.read.parquet(f"{DIR}/documents.parquet"))
    grow = F.pmod(F.xxhash64(*[F.col(x).cast("double") for x in quality.FEATURES]), F.lit(3)) != 0
    rows = [r for r in stats.withColumn("grow", grow).collect() if known.get(r["doc_id"]) is not None and r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]]
    values = [({f: float(r[f]) for f in quality.FEATURES}, known[r["doc_id"]] == 1, r["grow"]) for r in rows]
    labelled = spark.createDataFrame([(*v.values(), t) for v, t, _ in values], ", ".join(f"{f} double" for f in quality.FEATURES) + ", target boolean")
    for how in ({}, {"least_cover": 2, "least_precision": 0.5, "max_literals": 2}):
        rules, default = quality.learn(labelled, **how)
        want, otherwise = plain.covering(values, quality.FEATURES, **how)
        assert [[(x.feature, x.above, x.bound) for x in r.literals] for r in rules] == [[tuple(x) for x in r] for r in want]
        assert default == otherwise


@pytest.mark.parametrize("rows", [100_000, 1_000_000])
def test_recall_at_the_bits_of_large_tables(spark, monkeypatch, rows):
    """Pairs at and above the threshold, with the bits and tables that so many vectors of a label would have."""
    bits, tables = neardup_vectors.plan_tables(rows, 0.93)
    monkeypatch.setattr(neardup_vectors, "plan_tables", lambda n, c: (bits, tables))
    r = np.random.default_rng(1)
    made = []
    for i in range(150):
        a, b = r.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.931 + 0.03 * (i % 3)
        made += [(2 * i, a.tolist(), 1), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 1)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")
    got = {x["vec_id"]: x["component_id"] for x in neardup_vectors.near_duplicates(df).collect()}
    found = sum(got[2 * i + 1] == 2 * i for i in range(150))
    assert found >= 0.9 * 150 and bits >= (12 if rows < 10**6 else 15)


def test_slices_of_empty_texts():
    from plumbline.llm.bpe import ByteBPE
    from plumbline.llm.queries import tokenizer
    from plumbline.llm.token_files import _Encoder

    words, pieces_ = _Encoder(tokenizer("word_bpe_49k.json")), ByteBPE(tokenizer("byte_bpe_50k.json"))
    assert words(["", ""]) == pieces_.encode_all(["", ""]) == [b"", b""] and words([" ", ""]) == [b"", b""]


def test_splits_alike():
    """Pieces of texts of all plain characters, against the library on whole texts."""
    from tokenizers import Tokenizer

    from plumbline.llm.bpe import ByteBPE
    from plumbline.llm.queries import tokenizer
    from plumbline.llm.token_files import _Encoder

    r = random.Random(4)
    every = [chr(c) for c in range(0x180)] + list("\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac") + ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "  ", "\t\n", "\x85", "\u4e2d", "<|endoftext|>", "Word"]
    few = list("ab1 '\n\t!?\u00e9") + ["  ", "'s", "'re", " '"]
    for name, code in (("word_bpe_49k.json", _Encoder(tokenizer("word_bpe_49k.json"))), ("byte_bpe_50k.json", ByteBPE(tokenizer("byte_bpe_50k.json")).encode_all)):
        own = Tokenizer.from_file(tokenizer(name))
        own.no_truncation()
        own.no_padding()
        texts = ["".join(r.choice(k) for _ in range(r.randrange(20))) for k in (every, every[:128], few) for _ in range(500)]
        got = [np.frombuffer(x, "<u4").tolist() for x in code(texts)]
        assert got == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_pair_tests_hold_for_merges():
    """The walk by rank agrees with merging the joint bytes."""
    from plumbline.llm.bpe import ByteBPE
    from plumbline.llm.queries import tokenizer

    bpe, r = ByteBPE(tokenizer("byte_bpe_50k.json")), random.Random(1)
    tokens = [t for t in bpe.bytes if t < 50256]
    assert bpe.by_rank
    for _ in range(5000):
        a, b = r.choice(tokens), r.choice(tokens)
        assert bpe.compatible(a, b) == (bpe.merged(bpe.bytes[a] + bpe.bytes[b]) == [a, b])
