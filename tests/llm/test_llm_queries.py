"""Every query of the training-data operators over its whole small table, against plain versions."""

import collections
import hashlib
import zlib

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from plumbline.llm import queries as q
from plumbline.llm import secrets

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DIR}/documents.parquet").to_pylist()


def collected(spark, name):
    return {r["doc_id"]: r for r in q.QUERIES[name](spark, DIR).collect()}


def test_sharding(spark, docs):
    got = collected(spark, "op1_sharding")
    assert len(got) == len(docs)
    shards, total = collections.defaultdict(list), 0
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(brute.utf8(d["text"])) + 16, brute.crc(d["text"]), "bytes", None)
        shards[r["shard"]].append(r)
        total += r["size"]
    assert set(shards) <= set(range(40))
    largest = max(r["size"] for r in got.values())
    for s in range(40):
        assert sorted(r["slot"] for r in shards[s]) == list(range(len(shards[s])))
        assert abs(sum(r["size"] for r in shards[s]) - total / 40) <= largest


def test_language(spark, docs):
    got = collected(spark, "op2_language")
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {k for k, r in got.items() if r["held_out"]} == {d["doc_id"] for d in held}
    right = sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held if any(c.isalpha() for c in d["text"]))
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_mixing(spark, docs):
    got = collected(spark, "op3_mixing")
    size = collections.Counter()
    for d in docs:
        assert got[d["doc_id"]]["size"] == len(brute.words(d["text"]))
        size[d["source"]] += got[d["doc_id"]]["size"]
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} or {s: left * weight[s] / w for s in open_}
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    taken = collections.Counter()
    for d in docs:
        r = got[d["doc_id"]]
        assert r["source_size"] == size[d["source"]] and abs(r["target"] - target[d["source"]]) < 1e-6 and r["taken"] in [k * r["size"] for k in range(4)]
        taken[d["source"]] += r["taken"]
    largest = max(r["size"] for r in got.values())
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in names)
    assert {k: r["taken"] for k, r in collected(spark, "op3_mixing").items()} == {k: r["taken"] for k, r in got.items()}


def test_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{DIR}/embeddings.parquet").to_pylist()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in q.op4_embeddings(spark, DIR).collect()}
    assert got == brute.vector_groups(rows)


def test_quality(spark, docs):
    got = collected(spark, "op5_quality")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DIR}/labels.parquet").to_pylist()}
    right = n = 0
    for d in docs:
        r, want = got[d["doc_id"]], brute.base_counts(d["text"])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        if not failed and labels.get(d["doc_id"]) is not None:
            n += 1
            right += r["kept"] == (labels[d["doc_id"]] == 1)
    assert right >= 0.8 * n


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    start, got = 0, collected(spark, "op6_token_files")
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_jaccard(spark, docs):
    got = {k: (r["n_shingles"], r["component_id"]) for k, r in collected(spark, "op7_jaccard").items()}
    assert got == brute.jaccard_groups([(d["doc_id"], d["text"]) for d in docs])


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    got = collected(spark, "op8_bpe")
    for d in docs:
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_secrets(spark, docs):
    got = collected(spark, "op9_secrets")
    for d in docs:
        r, spans = got[d["doc_id"]], brute.secret_spans(d["text"], secrets.RULES)
        base = [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")]
        assert r["spans"] == ",".join(spans)
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


def test_substrings(spark, docs):
    got = {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in collected(spark, "op10_substrings").items()}
    assert got == brute.repeats([(d["doc_id"], d["text"]) for d in sorted(docs, key=lambda d: d["doc_id"])])


def test_vector_codes(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{DIR}/embeddings.parquet").to_pylist()]
    want, digest = brute.vector_codes(rows)
    got = q.op11_vector_codes(spark, DIR).collect()
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want and len(got) == len(want)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_periodic_runs(spark, docs):
    got = collected(spark, "op12_periodic_runs")
    assert len(got) == len(docs)
    for d in docs:
        w = brute.planted_words(d["doc_id"], brute.words(d["text"]))
        runs, r = brute.periodic_runs(w), got[d["doc_id"]]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(top or (None,) * 3))
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{m},{p}\n" for a, m, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute.collapsed(w, runs).encode()).hexdigest()


def test_warc(spark):
    pages = [(r["page_id"], r["html"]) for r in pq.read_table(f"{DIR}/pages.parquet").to_pylist()]
    got = q.op13_warc(spark, DIR).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == brute.warc_facts(pages)
    assert len(got) == len(pages)
