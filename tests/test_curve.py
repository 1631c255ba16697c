"""Tables along a space-filling curve: look-ups on each key read few files, and the same rows."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.plans.matching import save
from plumbline.sources.curve import curve_place, with_ranks, write_curve
from plumbline.sources.io import write_table


def rows_read(df) -> int:
    """Rows that the scan of a table hands on: those of row groups that statistics and Bloom filters leave."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
            continue
        if plan.getClass().getSimpleName() == "FileSourceScanExec":
            total += plan.metrics().apply("numOutputRows").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def within(path: str, column: str, value: float) -> int:
    """Files whose statistics allow the value."""
    out = 0
    for f in glob.glob(f"{path}/*.parquet"):
        facts = pq.ParquetFile(f).metadata
        at = facts.schema.names.index(column)
        stats = [facts.row_group(g).column(at).statistics for g in range(facts.num_row_groups)]
        out += any(s.min <= value <= s.max for s in stats)
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    """Each of 400 players with 50 of 300 teams."""
    h = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(10**6))
    return spark.range(20_000).select((F.col("id") % 400).alias("player_id"), (h(1) % 300).alias("team_row_id"), (h(2) / 10**4).alias("match_percentage"), F.col("id").alias("row")).cache()


def test_each_key_prunes_files(pairs, spark, tmp_path):
    curve, ordered = str(tmp_path / "curve"), str(tmp_path / "ordered")
    keys = ["player_id", "team_row_id", "match_percentage"]
    write_curve(pairs, f"file://{curve}", keys, ["player_id", "team_row_id"], 64)
    write_table(pairs, f"file://{ordered}", ["player_id", "match_percentage"], 64)
    assert len(glob.glob(f"{curve}/*.parquet")) == 64
    # 4 x 4 x 4 boxes, cut at sampled ranges: a value of one key is in about 16 of 64 files, in place of all for the second
    for key, value in [("player_id", 77), ("team_row_id", 123)]:
        assert within(curve, key, value) <= 32
        want = sorted(map(tuple, pairs.where(F.col(key) == value).collect()))
        found = spark.read.parquet(f"file://{curve}").where(F.col(key) == value)
        assert sorted(map(tuple, found.collect())) == want
        assert rows_read(found) <= 20_000 * 0.5
    assert within(ordered, "team_row_id", 123) == 64
    assert spark.read.parquet(f"file://{curve}").count() == 20_000


def test_bloom_filters_leave_out_absent_ids(spark, tmp_path):
    """Even ids in two files: statistics allow an odd one, Bloom filters don't."""
    df = spark.range(0, 20_000, 2).select("id", (F.col("id") % 7).alias("other"))
    path = f"file://{tmp_path}/bloom"
    write_curve(df, path, ["id", "other"], {"id": 10_000}, 2)
    assert rows_read(spark.read.parquet(path).where("id = 5001")) == 0
    assert rows_read(spark.read.parquet(path).where("id = 5002")) > 0
    write_curve(df, path, ["id", "other"], (), 2)
    assert rows_read(spark.read.parquet(path).where("id = 5001")) > 0


def test_ranks_and_places(spark):
    got = spark.range(1).select(curve_place([F.lit(5), F.lit(3)], 3).alias("p"), curve_place([F.lit(9)], 3).alias("q")).first()
    assert got == (0b100111, 1)  # 1 0 1 and 0 1 1, bit by bit; the fourth bit isn't used
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (4.0, 1.0), (float("inf"), 1.0)], "x double, `y.z` double")
    out, ranks = with_ranks(df, ["x", "y.z"], 3)
    rows = [tuple(r) for r in out.select("x", *ranks).collect()]
    assert [r[1] for r in rows[:2]] == [0, 0] and all(r[1] >= 1 for r in rows[2:])
    assert [r[1] for r in rows[2:]] == sorted(r[1] for r in rows[2:]) and max(r[1] for r in rows) < 8
    assert len({r[2] for r in rows}) == 1
    with pytest.raises(ValueError):
        curve_place([F.lit(1)] * 8, 8)


def test_odd_tables(spark, tmp_path):
    """Empty tables, a key of one value, nulls and names with dots come back whole."""
    path = f"file://{tmp_path}/odd"
    df = spark.createDataFrame([(None, 1), (1, 1), (1, 1), (2, 1)], "`a.b` int, c int")
    write_curve(df, path, ["a.b", "c"], ["c"], 3)
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, df.collect()))
    write_curve(df.limit(0), path, ["a.b", "c"], ["c"], 3)
    assert spark.read.parquet(path).count() == 0


def test_match_tables_are_saved(pairs, spark, tmp_path):
    """Tables of the matching plan: those with rankings along the curve, the rest as they are."""
    tables = {"player_top_team_matches": pairs.select("player_id", F.col("row").alias("player_row_id"), "team_row_id", "match_percentage"), "ml_dimension_weights": spark.createDataFrame([("a", 1.0)], "dimension string, weight double")}
    save(tables, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/player_top_team_matches").count() == 20_000
    assert spark.read.parquet(f"file://{tmp_path}/out/ml_dimension_weights").collect() == [("a", 1.0)]
