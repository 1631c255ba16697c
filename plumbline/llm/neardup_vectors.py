"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine checks, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, partitions, scratch


def plan_tables(rows: int, cosine: float, miss: float = 5e-4, per_bucket: int = 24) -> tuple[int, int]:
    """Bits a table and number of tables: about ``per_bucket`` unrelated rows a bucket, and each pair at the
    threshold shares a bucket in some table but with chance ``miss``."""
    bits = min(24, max(4, round(math.log2(max(1, rows / per_bucket)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, record: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 512, seed: int = 11) -> DataFrame:
    """Rows ``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors`` (by the names given).

    Vectors are compared only where labels are equal and not null and dimensions agree.  A vector that is null,
    empty, zero or holds null or non-finite components links with nothing, nor does a row with a null id.  Equal
    vectors of a label are one class with a weight, so copies cost nothing; ``n_links`` counts the other rows.  Rows
    that share an id are one node.  No pair below the threshold is linked; a pair at it is missed with the chance
    that :func:`plan_tables` states, a closer one less often.  A table gets a vector as 16-bit numbers with a bound of
    what they are off by; pairs for which that leaves a doubt are decided by the vectors themselves.  Crowded buckets
    are cut into blocks that meet in pairs, known by 64-bit hashes; a group in a task is some such cells, of two blocks
    at most each; as every link is counted, work on a
    crowd of really near vectors is that of its pairs.  Other columns aren't looked at.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(record).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("string").alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("x") > 0, F.lit(False)) & ~F.coalesce(F.exists("x", bad), F.lit(True)) & F.coalesce(F.exists("x", lambda c: c != 0), F.lit(False))
    v = scratch(v.withColumn("ok", F.coalesce(usable, F.lit(False))), "vectors")
    classes = scratch(v.where("ok").groupBy("label", "x").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("w")), "classes")
    n = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(n, cosine)
    width = 1 if bits <= 8 else 2 if bits <= 16 else 4

    def sign_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("x")
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), bits * tables))
                x = flat[starts[at][:, None] + np.arange(d)]
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                signs = (x @ planes[d] > 0).reshape(len(at), tables, bits)
                hashes = (signs * (1 << np.arange(bits))).sum(2).astype(f"<u{width}")
                step = np.abs(x).max(1, keepdims=True) / 32767
                short = np.rint(x / step).astype("<i2")
                off = np.sqrt(((x - short * step) ** 2).sum(1))
                binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column("label"), pa.array(np.full(len(at), d, np.int32)), own.column("c"), own.column("w"), binary(x), binary(short), pa.array(step[:, 0]), pa.array(off), binary(hashes)], names=["label", "dim", "c", "w", "unit", "short", "step", "off", "hashes"])

    hashed = scratch(classes.mapInArrow(sign_hashes, "label string, dim int, c long, w long, unit binary, short binary, step double, off double, hashes binary"), "hashes")
    # one row for each table: the hash of table t is its t-th little-endian integer; of the vector only 16-bit numbers go
    dealt = hashed.drop("unit").select("*", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t")).withColumn("h", F.expr(f"substring(hashes, t * {width} + 1, {width})"))
    bucket = ["label", "dim", "t", "h"]
    # few buckets are crowds; written, so that Spark broadcasts them where it measures them as small
    crowds = scratch(dealt.groupBy(*bucket).agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > block), "crowds")
    cells = (
        dealt.join(crowds, bucket, "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("crowd") / block).cast("int"), F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "w", "short", "step", "off", "hashes")
        .withColumn("cell", F.xxhash64(*bucket, "i", "j"))
        .select("cell", "t", "i", "j", "own", "c", "w", "short", "step", "off", "hashes")
    )

    def meet(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Of one cell: classes with links or a smaller near one as root, and pairs that are in doubt."""
        t, i, j, own, ids, weight = int(rows["t"][0]), rows["i"][0], rows["j"][0], rows["own"], rows["c"], rows["w"]
        x = np.frombuffer(b"".join(rows["short"]), dtype="<i2").reshape(len(ids), -1) * rows["step"][:, None]
        off = rows["off"] + 1e-12
        a = np.flatnonzero(own == i)
        b = a if i == j else np.flatnonzero(own == j)
        near = x[a] @ x[b].T
        # what the short numbers can be off by, for a pair at most
        doubt = off[a][:, None] + off[b] * (1 + off[a][:, None])
        p, q = np.nonzero(near >= cosine - doubt)
        sure = near[p, q] >= cosine + doubt[p, q]
        p, q = a[p], b[q]
        # a pair belongs to the first table in which it meets
        once = p < q if i == j else np.ones(len(p), bool)
        if t and once.any():
            hashes = np.frombuffer(b"".join(rows["hashes"]), dtype=f"<u{width}").reshape(len(ids), -1)
            once &= ~(hashes[p, :t] == hashes[q, :t]).any(1)
        ask, new = once & ~sure, once & sure
        # links count once; what is surely near joins a group in whatever table
        links = np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, p[new], weight[q[new]])
        np.add.at(links, q[new], weight[p[new]])
        asked = ids[p[ask]], ids[q[ask]]
        p, q = p[sure], q[sure]
        root = np.arange(len(ids))
        while len(p):
            low = np.minimum(root[p], root[q])
            was = root.copy()
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            root = root[root]
            if (root == was).all():
                break
        out = (links > 0) | (root != np.arange(len(ids)))
        return ids[out], links[out], ids[root[out]], *asked

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        """Many cells at once: Python's cost a group would be more than that of a small cell's pairs."""
        rows = rows.sort_values(["cell", "c"], kind="stable")
        columns = {n: rows[n].to_numpy() for n in rows.columns}
        cut = [0, *(np.flatnonzero(np.diff(columns["cell"])) + 1).tolist(), len(rows)]
        parts = [meet({n: v[lo:hi] for n, v in columns.items()}) for lo, hi in zip(cut[:-1], cut[1:])]
        c, links, root, one, two = (np.concatenate([p[k] for p in parts]) for k in range(5))
        none = np.zeros(len(one), np.int64)
        return pd.DataFrame({"c": np.concatenate([c, one]), "other": np.concatenate([c, two]), "links": np.concatenate([links, none]), "root": np.concatenate([root, none])})

    groups_ = max(partitions(spark), -(-classes.count() * tables // 8192))
    found = scratch(cells.groupBy(F.pmod("cell", F.lit(groups_))).applyInPandas(verify, "c long, other long, links long, root long"), "links")
    # pairs within what short numbers can be off by: the vectors themselves decide
    side = lambda n: hashed.select(F.col("c").alias(n), F.col("w").alias(f"w{n}"), F.col("unit").alias(f"x{n}"))
    unsure = found.where("c <> other").select(F.col("c").alias("a"), F.col("other").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype=np.float64) for n in ("xa", "xb"))
            ends = np.cumsum(pc.binary_length(batch.column("xa")).to_numpy()) // 8
            sums = np.array([x[lo:hi] @ y[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends)])
            yield batch.select(["a", "b", "wa", "wb"]).filter(pa.array(sums >= cosine, pa.bool_()))

    checked = scratch(unsure.mapInArrow(exact, "a long, b long, wa long, wb long"), "links")
    surely = found.where("c = other").select("c", "links", "root")
    found = surely.unionByName(checked.select(F.col("a").alias("c"), F.col("wb").alias("links"), F.col("b").alias("root"))).unionByName(checked.select(F.col("b").alias("c"), F.col("wa").alias("links"), F.col("a").alias("root")))
    linked = found.groupBy("c").agg(F.sum("links").alias("links"))
    groups = components(found.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b")))
    facts = classes.join(linked, "c", "left").join(groups.withColumnRenamed("node", "c"), "c", "left").select("label", "x", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("component"))
    out = v.where("ok").join(facts, ["label", "x"], "left").select("id", "n_links", "component").unionByName(v.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(record), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
