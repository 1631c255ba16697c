"""The stages of the corpus pipeline, each against a plain version on its own input."""

import tracemalloc
import weakref

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from plumbline.llm import bpe, langid, secrets
from plumbline.llm.queries import tokenizer

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = pq.read_table(f"{DIR}/documents.parquet").to_pylist()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "mask_secrets", "mix_sources", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        after = [r.asDict() for r in docs.collect()]
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"])}
        elif name == "near_duplicates":
            groups = brute.jaccard_groups([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in groups.values()})
        elif name == "mask_secrets":
            assert len(after) == len(before)
            old = {r["doc_id"]: r["text"] for r in before}
            for r in after:
                assert r["n_chars"] == len(r["text"])
                assert (r["text"] == old[r["doc_id"]]) == (not brute.secret_spans(old[r["doc_id"]], secrets.RULES))
        elif name == "mix_sources":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
            words, total = sum(len(brute.words(r["text"])) for r in after), sum(len(brute.words(r["text"])) for r in before)
            assert abs(words - total) <= max(len(brute.words(r["text"])) for r in before)
        else:
            t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
            t.no_truncation()
            t.no_padding()
            texts = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before)
            for r in after:
                assert np.frombuffer(r["ids"], "<u4").tolist() == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        before = after


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, row string, lang_pred string, secrets string, size string, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), *["?"] * 6) for i, t, lang, src in rows], SCHEMA)


def test_stages_on_odd_rows(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977} of{i}" for i in range(40_000))
    rows = [(1, "the cat sat on the mat by the door of the house", "en", "a"), (1, "the cat sat on the mat by the door of the house", "en", "a"), (2, "THE cat sat on the mat by the door of the house", None, None), (3, None, "en", "a"), (4, "", None, None), (5, "12 34", "de", "b"), (6, long, "en", "a"), (7, long + " more", None, "b"), (8, "token = 'abcdefgh' and so on", "en", None), (None, "ein Satz ohne Nummer", "de", None), (None, "ein Satz ohne Nummer", "de", None), (None, None, None, None)]
    docs = frame(spark, rows)
    named = corpus_pipeline.language(spark, docs, DIR)
    assert named.columns == corpus_pipeline.COLUMNS
    assert sorted(str(r["doc_id"]) for r in named.collect()) == sorted(str(i) for i, t, *_ in rows if t and any(c.isalpha() for c in t))
    unique = corpus_pipeline.near_duplicates(spark, docs, DIR)
    assert unique.columns == corpus_pipeline.COLUMNS
    assert sorted(str(r["doc_id"]) for r in unique.collect()) == sorted(["1", "3", "4", "5", "6", "8", "None", "None"])
    masked = corpus_pipeline.mask_secrets(spark, docs, DIR)
    found = masked.collect()
    assert masked.columns == corpus_pipeline.COLUMNS and len(found) == len(rows)
    assert [r["text"] for r in found if r["doc_id"] == 8] == ["[ASSIGN]' and so on"] and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found)
    mixed = corpus_pipeline.mix_sources(spark, docs, DIR)
    assert mixed.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in mixed.collect()} <= {1, 2, 5, 6, 7, 8, None}
    coded = {(r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.tokens(spark, docs, DIR).collect()}
    assert {(3, 0), (4, 0), (None, 0)} <= coded and len(coded) == 10


def test_stages_on_no_rows(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def _peak(work) -> float:
    """MB that Python and NumPy take at most during ``work``."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_worker_keeps_one_stage_s_tables():
    """A worker that goes from tokens to the next run's languages and back has tables of one at a time."""
    path = tokenizer("byte_bpe_50k.json")
    model = langid.fit(np.array(["en", "de"], dtype=object), np.array([0x20202061, 0x20206162]), np.array([3.0, 2.0]))
    coder = bpe._opened(path)
    assert bpe._opened(path) is coder
    gone = weakref.ref(coder)
    del coder
    index = langid._index(model, "some model")
    assert gone() is None
    assert langid._index(model, "some model") is index
    gone = weakref.ref(index[0])
    del index
    bpe._opened(path)
    assert gone() is None


def test_memory_of_long_slices():
    """Coding a slice of some MB takes a few MB besides it, for languages as for tokens."""
    r = np.random.default_rng(3)
    texts = ["".join(map(chr, r.choice([*range(97, 123), 32], 4000))) for _ in range(1000)]
    grams, n = np.unique(r.integers(0x61616161, 0x7A7A7A7A, 20000), return_counts=True)
    model = langid.fit(np.repeat(np.array(["en", "de", "fr", "es"], dtype=object), len(grams)), np.tile(grams, 4), np.tile(n.astype(float), 4))
    column = pa.array(texts, pa.large_string())
    index = langid._index(model, "model of long slices")
    assert _peak(lambda: langid.code_lengths(model, index, column)) < 30
    lo, hi = next(bpe._chunks(column))
    assert sum(map(len, texts[lo:hi])) <= 300_000
