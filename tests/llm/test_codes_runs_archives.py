"""Vector codes, periodic runs and WARC bundles on odd rows, against plain versions."""

import glob
import io
import random
import subprocess

import brute
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from plumbline.llm import periodic_runs, vector_codes, warc
from plumbline.llm.queries import with_planted_runs

ODD = ["code", "error", "label_error", "x", "id", "group", "vector", "part", "a.b", "runs", "collapsed", "n_words", "w", "digest", "first", "key", "payload", "low", "refers"]


def odd(df):
    """With further columns of clashing names."""
    return df.withColumns({c: F.lit("?") for c in ODD if c not in df.columns})


@pytest.mark.parametrize("scale,kind", [(1, np.int64), (2**50, object)])
def test_nearest_entry_is_exact(scale, kind):
    rng = np.random.default_rng(3)
    for n, width in ((1, 3), (2, 1), (5, 2), (64, 4), (200, 8)):
        book = rng.integers(-30, 30, (n, width)).astype(kind) * scale
        if n > 4:
            book[4] = book[1]  # ties go to the lower index
        points = np.concatenate([rng.integers(-40, 40, (300, width)).astype(kind) * scale, book])
        index, squares, _ = vector_codes.nearest(vector_codes.tree(book), book, points)
        every = ((points[:, None, :] - book[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (squares == every.min(1)).all()


def test_tree_leaves_entries_out():
    """Of clustered entries most aren't compared."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-20_000, 20_000, (8, 4))
    book = np.concatenate([c + rng.integers(-50, 50, (8, 4)) for c in centres])
    points = book[rng.integers(0, 64, 2000)] + rng.integers(-50, 50, (2000, 4))
    _, _, taken = vector_codes.nearest(vector_codes.tree(book), book, points)
    assert taken < 0.4 * 64 * len(points)


def _vectors(spark, rows, kind="double"):
    return odd(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int"))


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in np.round(rng.standard_normal(32), 2)], [None, 1, 2][i % 3]) for i in range(90)]
    bad = [(200, None, 1), (201, [float("nan")] * 32, 1), (202, [1.0] * 31 + [None], 2), (203, [float("inf")] * 32, None), (204, [], 1)]
    out, books = vector_codes.compress(_vectors(spark, rows + bad).repartition(4))
    want, digest = brute.vector_codes(rows)
    got = out.collect()
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want and len(got) == 90
    assert books.digest() == digest and books.size == 32 and not books.wide
    # another length than the codebooks' can't be coded; columns pass through
    more = vector_codes.encode(_vectors(spark, [*rows[:3], rows[1], (None, rows[0][1], 1), (300, [1.0] * 16, 1)]), books)
    assert more.columns == ["vec_id", "embedding", "label", *[c for c in ODD if c not in ("code", "error")], "code", "error"]
    coded = {r["vec_id"]: r["code"] for r in more.collect()}
    assert coded == {0: want[0][0], 1: want[1][0], 2: want[2][0], None: want[0][0]} and more.count() == 5


def test_codes_of_few_repeated_and_no_vectors(spark):
    few = [(i, [float(i)] * 16, 1) for i in range(5)]
    want, digest = brute.vector_codes(few)
    out, books = vector_codes.compress(_vectors(spark, few))
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in out.collect()} == want and books.digest() == digest
    out, books = vector_codes.compress(_vectors(spark, few + few))
    assert out.count() == 10 and {r["error"] for r in out.collect()} == {0}
    for none in ([], [(1, None, 1)], [(1, [float("nan")] * 16, 1)]):
        out, books = vector_codes.compress(_vectors(spark, none))
        assert out.count() == 0 and books is None


def test_codes_of_very_large_components(spark):
    """Integers that don't fit 64 bits when squared."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) * 2.0**40 for v in rng.integers(-9, 9, 16)], i % 2) for i in range(80)]
    rows += [(500 + i, [1e30] * 16, 0) for i in range(2)]
    want, digest = brute.vector_codes(rows[:80])
    out, books = vector_codes.compress(_vectors(spark, rows))
    got = {r["vec_id"]: r for r in out.collect()}
    assert books.wide and books.digest() == digest and len(got) == 80
    assert {i: r["code"] for i, r in got.items()} == {i: w[0] for i, w in want.items()}
    assert {i: r["error"] for i, r in got.items()} == {i: w[1] if w[1] < 2**63 else None for i, w in want.items()}


def _texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        w = []
        for _ in range(r.randrange(0, 7)):
            if r.random() < 0.6:
                unit = [f"v{r.randrange(r.choice([1, 2, 3, 50]))}" for _ in range(r.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 30, 70]))]
                w += (unit * 8)[: r.randrange(1, 8 * len(unit))]
            else:
                w += [f"v{r.randrange(r.choice([2, 5, 100]))}" for _ in range(r.randrange(40))]
        yield w


@pytest.mark.parametrize("key,chunk", [(64, 1 << 19), (4, 50), (1, 8)])
def test_runs_are_those_of_the_definition(monkeypatch, key, chunk):
    monkeypatch.setattr(periodic_runs, "_KEY", key)
    texts = list(_texts(key, 400))
    h = np.array([hash(x) % 2**63 for t in texts for x in t], dtype=np.uint64)
    rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = [[(a, b - a, q) for a, b, q in runs] for runs in periodic_runs.runs_of(h, rows, chunk=chunk)]
    assert got == [brute.periodic_runs(t) for t in texts]
    assert sum(map(len, got)) > 300


def test_periods_of_all_lengths():
    """Units of many different words, up to some thousand, four times each and a word less."""
    for q in (1, 2, 3, 31, 32, 33, 63, 64, 65, 127, 500, 1024, 3000):
        for n in (4 * q, 4 * q - 1):
            w = np.concatenate([[10**6, 10**6 + 1], np.tile(np.arange(q), 4)[:n], [10**6 + 2]]).astype(np.uint64)
            got = periodic_runs.runs_of(w, np.array([0, len(w)]))[0]
            assert got == ([(2, 2 + n, q)] if n >= max(6, 4 * q) else [])


def test_runs_of_odd_texts(spark):
    unit = " ".join(f"u{i}" for i in range(700))
    rows = [(1, "a a a a a a"), (1, "a a a a a a"), (2, "a a a a a"), (3, None), (4, ""), (5, " \n\t\x0b "), (6, "b\nx y\tx y x y  x y z"), (7, f"start {unit} " + f"{unit} " * 6 + "u0 u1 end"), (None, "é é é é é é é é"), (8, "no runs in here at all")]
    df = odd(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    found = periodic_runs.find_runs(df)
    assert found.columns == [c for c in df.columns if c not in ("n_words", "runs", "collapsed")] + ["n_words", "runs", "collapsed"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        w = brute.words(r["text"])
        runs = brute.periodic_runs(w)
        assert r["n_words"] == len(w) and [(x["start"], x["length"], x["period"]) for x in r["runs"]] == runs
        assert r["collapsed"] == brute.collapsed(w, runs)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, times=3)


def test_planted_runs(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 60))) for i in range(200)] + [(None, "x y"), (9, None), (9, "")]
    got = sorted((r["doc_id"] or -1, tuple(brute.words(r["text"]))) for r in with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i or -1, tuple(brute.planted_words(i, brute.words(t)))) for i, t in rows)


@pytest.fixture(scope="module")
def pages(spark):
    same, short = "é" * 80, "short"
    rows = [(i, f"http://x.example/{i}", f"<p>{i}</p>" * 40) for i in range(30)]
    rows += [(40, "http://x.example/a b\r\nWARC-Type: fake", same), (35, None, same), (50, "", same), (None, "u", same), (60, "u", short), (61, "u", short), (62, "u", None), (63, "u", ""), (64, "u", "\r\n\r\nWARC/1.1\r\n\r\n\x00"), (65, "u", "y" * 300_000)]
    rows += [(35, None, same), (0, "http://x.example/0", "<p>0</p>" * 40)]
    return odd(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3)


@pytest.fixture(scope="module")
def archive(pages, tmp_path_factory):
    path = tmp_path_factory.mktemp("warc") / "out"
    warc.write(pages, f"file://{path}", frame=3000, bundle=3)
    return str(path)


def test_archives_give_back_every_page(spark, pages, archive):
    source = pages.collect()
    want = brute.warc_facts([(r["page_id"], r["html"]) for r in source])
    read = warc.read(spark, f"file://{archive}")
    got = warc.resolve(read).collect()
    assert len(got) == len(source)
    for r in got:
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want[r["page_id"]]
    html = {r["page_id"]: (r["html"] or "").encode() for r in source}
    for r in read.collect():
        assert r["payload"] == (html[r["key"]] if r["record_type"] == "response" else b"")
        assert r["digest"] == want[r["key"]][1] and r["record_id"] == str(warc.record_id(r["key"], r["digest"]))
    addresses = {r["key"]: r["url"] for r in read.collect()}
    assert addresses[35] is None and addresses[50] == "" and addresses[40] == "http://x.example/a%20b%0D%0AWARC-Type:%20fake"


def test_bundles_are_plain_zstandard(archive):
    names = glob.glob(f"{archive}/part-*")
    raw = b"".join(zstandard.ZstdDecompressor().stream_reader(open(n, "rb"), read_across_frames=True).read() for n in names)
    assert raw.count(b"\r\nWARC-Record-ID: <urn:uuid:") == 42
    assert len(names) > 5  # at most three frames in each
    for n in names:
        bundle = warc.Bundle(open(n, "rb").read())
        assert 1 <= len({int(f) for f in bundle.places()["frame"]}) <= 3
        for place in bundle.places():
            fields, _ = warc.parse(bundle.frame(int(place["frame"]))[place["offset"] : place["offset"] + place["length"]])
            assert fields["warc-record-id"] == f"<urn:uuid:{warc.record_id(None if place['nameless'] else int(place['key']), fields['warc-payload-digest'][7:])}>"
    if subprocess.run(["sh", "-c", "command -v zstd"], capture_output=True).returncode == 0:
        assert subprocess.run(["zstd", "-dc"], stdin=open(names[0], "rb"), capture_output=True, check=True).stdout


def test_records_are_found_by_their_places(spark, archive):
    places = warc.index(spark, f"file://{archive}")
    rows = places.collect()
    assert len(rows) == 42
    ids = [r["record_id"] for r in rows if r["key"] in (7, 65, 50)]
    got = {r["key"]: r for r in warc.fetch(spark, places, [*ids, "missing"]).collect()}
    assert set(got) == {7, 65, 50} and got[7]["payload"] == b"<p>7</p>" * 40 and got[50]["record_type"] == "revisit"
    assert warc.fetch(spark, places, ["missing"]).count() == 0


def test_damage_is_noticed(archive):
    data = bytearray(open(glob.glob(f"{archive}/part-*")[0], "rb").read())
    with pytest.raises(ValueError):
        warc.Bundle(bytes(data[:-1]))
    first = warc.Bundle(bytes(data))
    data[int(first.starts[1]) - 1] ^= 1  # the last byte of the first frame
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.Bundle(bytes(data)).frame(0)
    with pytest.raises(ValueError):
        warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc").read())


def test_empty_archives(spark, pages, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write(pages.limit(0), path)
    assert warc.read(spark, path).count() == 0 and warc.index(spark, path).count() == 0
    assert warc.resolve(warc.read(spark, path)).count() == 0
